"""Reading messy JSON through VARIANT: parse once, probe with ``try_`` casts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


# Number words that JSON does not know but writers of such documents use.
_NO_NUMBER = r"(?<=[:,\[\s])-?(?:NaN|Infinity)(?=\s*[,}\]])"


def accept_repeated_keys(spark: SparkSession) -> None:
    """Documents with a key twice are read, the last value counts. It is a session setting
    of Spark's parser, so the scans of documents set it."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _odd(text: Column) -> Column:
    return text.contains("NaN") | text.contains("Infinity")


def parse(text: Column) -> Column:
    """JSON text to VARIANT; NULL, blank and malformed text give NULL. ``NaN`` and
    ``Infinity`` are read as null, which counts as missing like them."""
    plain = F.try_parse_json(text)
    mended = F.when(_odd(text), F.try_parse_json(F.regexp_replace(text, _NO_NUMBER, "null")))
    return F.coalesce(plain, mended)


# A value takes less than four times its text, so a document of up to this many bytes
# is within the parser's limit of 128 MiB.
LARGE = 32 << 20


def too_large(text: Column, v: Column) -> Column:
    """``parse`` gave nothing for a text that may be over its limit."""
    return F.coalesce(v.isNull() & (F.octet_length(text) > LARGE), F.lit(False))


def sections(text: Column, v: Column, wanted: Mapping[str, str]) -> Column:
    """The wanted sections of an object too large for ``parse``, NULL for all other texts.

    ``wanted`` names a type for each section, with VARIANT for single values. The text is
    streamed, and what the types do not name is skipped unread. A section that does not have
    its type is read whole, if it is within the limit by itself. A malformed text, and one
    without any wanted section, gives NULL.
    """
    plain = F.when(_odd(text), F.regexp_replace(text, _NO_NUMBER, "null")).otherwise(text)
    strict = {"allowSingleQuotes": "false"}

    def whole(name: str) -> Column:
        there = F.array_contains(F.json_object_keys(plain), name)
        return F.when(there, F.from_json(plain, f"{name} variant", strict)[name])

    def found(typed: Column) -> Column:
        kept = (F.coalesce(F.try_parse_json(F.to_json(typed[n])), whole(n)).alias(n) for n in wanted)
        return F.to_json(F.struct(*kept))

    typed = F.from_json(plain, ", ".join(f"{n} {shape}" for n, shape in wanted.items()), strict)
    # Bound to a name of its own, the typed reading is done once for all sections.
    result = F.get(F.transform(F.array(typed), found), F.lit(0))
    return F.when(
        too_large(text, v) & F.json_object_keys(plain).isNotNull(),
        F.try_parse_json(F.nullif(result, F.lit("{}"))),
    )


def unreadable(text: Column, v: Column) -> Column:
    """There is text, but neither a document nor a section could be read from it."""
    return F.coalesce(v.isNull() & text.rlike(r"\S"), F.lit(False))


def field(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def number(v: Column, path: str) -> Column:
    """Number or numeric text as double; anything else, and NaN, as NULL."""
    return F.nanvl(field(v, path, "double"), F.lit(None).cast("double"))


def integer(v: Column, path: str) -> Column:
    """Whole number, number cut towards zero, or integer text; else NULL."""
    return field(v, path, "bigint")


def text(v: Column, path: str) -> Column:
    return field(v, path, "string")


def fields(v: Column, spec: str) -> Column:
    """Several fields of an object in one call; a field that does not fit its type is
    NULL, and a value that is no object gives a NULL struct."""
    return F.try_variant_get(v, "$", f"struct<{spec}>")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def is_text(v: Column) -> Column:
    return kind(v) == "STRING"


# Text forms that can stand for an empty value: the rest is certainly not empty.
_MAYBE_EMPTY = ("", "0", "-0", "0.0", "-0.0", "false", "{}", "[]")


def certain(value: Column) -> Column:
    """Text that is not empty, whatever type it had."""
    return ~value.isin(*_MAYBE_EMPTY)


def truthy_text(v: Column, path: str) -> Column:
    """The field as text, or NULL where it is absent, null, empty, false or zero.

    Text ``"0"`` is kept: only the number zero is empty. The type of the field is looked
    up only where its text leaves a doubt.
    """
    value = text(v, path)
    return F.when(certain(value), value).when(
        (value != "") & is_text(field(v, path)), value
    )


def objects(v: Column, path: str) -> Column:
    """Elements of a JSON array, empty when the path is no array."""
    return F.coalesce(field(v, path, "array<variant>"), F.array().cast("array<variant>"))


def first_object(items: Column) -> Column:
    """First object of an array; the common case tests one element only."""
    head = F.get(items, F.lit(0))
    return F.when(is_object(head), head).otherwise(
        F.get(F.filter(items, is_object), F.lit(0))
    )


def as_object(v: Column) -> Column:
    """The coerced document: objects stay, JSON null, NULL and unreadable text become
    ``{}``, other values are wrapped as ``{"value": x}``."""
    return F.when(is_object(v), v).when(
        v.isNull() | F.is_variant_null(v), F.parse_json(F.lit("{}"))
    ).otherwise(F.to_variant_object(F.struct(v.alias("value"))))


def object_text(raw: Column, v: Column, part: Column) -> Column:
    """``as_object`` as JSON text. Unreadable text is kept as ``{"unparsed": text}``, and
    where ``part`` says that ``v`` has some sections only, the whole text is kept."""
    return (
        F.when(unreadable(raw, v), F.to_json(F.struct(raw.alias("unparsed"))))
        .when(part, raw)
        .otherwise(F.to_json(as_object(v)))
    )


def unnest(df, items: Column, name: str, *keep: str, pos: str | None = None):
    """One row per array element that is not NULL.

    The outer form keeps the optimizer from adding a size filter below, into which it
    would copy the whole expression that builds the array.
    """
    exploded = F.explode_outer(items).alias(name) if pos is None else F.posexplode_outer(
        items
    ).alias(pos, name)
    return df.select(*keep, exploded).where(F.col(name).isNotNull())
