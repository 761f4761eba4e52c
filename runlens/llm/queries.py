"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    decontaminate,
    licenses,
    neardup,
    packing,
    pii,
    quality,
    ranked,
    repeats,
    shards,
    url_filter,
    vector_codes,
    warc,
    wrapper,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
#: Fixed words; the blocklist is made of the URLs of all hosts that have one in their name.
LISTED_HOSTS = "adult|casino|cheap-pills|free-bets|spam-farm|ads-track"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build(table(spark, sf_dir, "documents"))
    return decontaminate.contamination(index, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write(pages)
    asked = pages.select("page_id", warc.surt(F.col("url")).alias("key"))
    captures = warc.lookup(archive, asked, id_col="page_id")
    return warc.fetch(archive, captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), quality.STANDARD)
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE.mask())) != 0
    return entries.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fail_bits", "version",
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrapper.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.joined(*(pii.span_text(k, F.col(f"base.{k}")) for k in pii.KINDS))
    return found.select(
        "doc_id",
        *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        pii.joined(base, pii.span_text("term", F.col("terms"))).alias("spans"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), n_shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_main_text": op6_main_text,
    "op7_pii": op7_pii,
    "op8_shards": op8_shards,
    "op9_packing": op9_packing,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_codes": op13_vector_codes,
}
