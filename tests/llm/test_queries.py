"""The registered queries against their SQL and against brute force on the smallest tables."""

from html.parser import HTMLParser

import pytest
import rows as R
from compare import connect, rows_of_duck, rows_of_spark

from runlens.llm.oracles import ORACLES
from runlens.llm.queries import QUERIES, table


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf_dir, name):
    columns, found = rows_of_spark(QUERIES[name](spark, sf_dir))
    want_columns, want = rows_of_duck(connect(sf_dir), ORACLES[name])
    assert columns == want_columns and found == want and found


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]


def test_decontamination(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {r.doc_id: r for r in QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir):
        n, hit, found = R.contamination(t, items)
        want = (i, n, hit, len(found), R.sha(",".join(found)), hit > 0)
        assert tuple(got[i]) == want


def test_pii(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir):
        assert got[i].base_sha256 == R.sha(R.pii(t)) and got[i].spans.startswith(R.pii(t))


def test_near_duplicates(spark, sf_dir):
    rows = texts(spark, sf_dir)
    got = {r.doc_id: r.component_id for r in QUERIES["op10_near_duplicates"](spark, sf_dir).collect()}
    assert got == dict(zip((i for i, _ in rows), R.classes(rows), strict=True))


def test_executors_need_no_copy_of_the_package(sf_dir):
    """The queries with Python code in tasks, started where tasks cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.abspath(os.path.join(os.path.dirname(__file__), "..", ".."))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
sys.path.insert(0, {root!r})
import corpus_pipeline
from runlens.llm.queries import QUERIES
for n in (2, 3, 6, 9, 10, 11, 12, 13):
    name = next(q for q in QUERIES if q.startswith(f"op{{n}}_"))
    QUERIES[name](spark, {sf_dir!r}).write.format("noop").mode("overwrite").save()
corpus_pipeline.run(spark, {sf_dir!r}).write.format("noop").mode("overwrite").save()
print("all done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True)
    assert "all done" in done.stdout, done.stderr[-3000:]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, dict(texts(spark, sf_dir))
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(kept["quality rules"]) < len(before)
    rows = sorted(kept["quality rules"].items())
    assert set(kept["near duplicates"]) == set(R.classes(rows))
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert set(kept["decontamination"]) == {
        i for i, t in kept["near duplicates"].items() if not R.contamination(t, items)[1]
    }
    assert set(kept["personal data"]) == set(kept["decontamination"])
    assert not any(R.pii(t) for t in kept["personal data"].values())
    for i, t in kept["personal data"].items():
        if not R.pii(kept["decontamination"][i]):
            assert t == kept["decontamination"][i]
    packed = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(kept["personal data"])


def test_pipeline_stores_its_stages(spark, sf_dir):
    import corpus_pipeline as C

    plan = C.run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and all(x not in plan for x in ("n_repeat", "sketch"))


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    import corpus_pipeline as C

    table(spark, sf_dir, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf_dir, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


class _Article(HTMLParser):
    """Text of the article of the tables' pages, whose only blocks are headings and paragraphs."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.blocks = False, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("h1", "p"):
            self.blocks.append("")
        elif tag == "br" and self.blocks:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_main_text(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    got = {r.page_id: r for r in QUERIES["op6_main_text"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, r in pages.items():
        want = "\n".join(filter(None, (" ".join(b.split()) for b in _Article(r.html or "").blocks)))
        assert tuple(got[i]) == (i, r.url, want, len(want))
