"""Validation of whole datasets of JSON records: required keys, completeness, consistent keys, lineage, and the report.

Records are rows (idx, record): the position and the JSON text. Errors are rows (idx, kind, key, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.formats import FIELDS

REQUIRED = FIELDS
MIN_CHARS = 5
_ENTRIES = "map<string,variant>"


def available_formats() -> list[str]:
    return list(REQUIRED)


def for_format(name: str) -> list[str]:
    if name not in REQUIRED:
        raise ValueError(f"unknown format '{name}'; known are {', '.join(REQUIRED)}")
    return REQUIRED[name]


def parsed(records: DataFrame) -> DataFrame:
    """(idx, entries): the entries of a JSON object as variants, none for other text. The one place where a record is parsed."""
    return records.select(F.col("idx").cast("long").alias("idx"), F.coalesce(F.from_json("record", _ENTRIES), F.from_json(F.lit("{}"), _ENTRIES)).alias("entries"))


def _error(kind: Column, key: Column | None = None, detail: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(kind.alias("kind"), text(key).alias("key"), text(detail).alias("detail"))


def _is_empty(value: Column) -> Column:
    """Null, an empty string or an empty list; 0, false and {} aren't empty."""
    return value.isNull() | F.is_variant_null(value) | F.coalesce(F.to_json(value).isin('""', "[]"), F.lit(True))


def _schema(fmt: str) -> Column:
    checks = [F.when(~F.map_contains_key("entries", k), _error(F.lit("missing"), F.lit(k))).when(_is_empty(F.try_element_at("entries", F.lit(k))), _error(F.lit("empty"), F.lit(k))) for k in REQUIRED[fmt]]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def _completeness() -> Column:
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    short = lambda e: (e["key"] != "metadata") & F.coalesce(F.length(T.strip(text(e["value"]))) < MIN_CHARS, F.lit(False))
    found = F.transform(F.filter(F.map_entries("entries"), short), lambda e: _error(F.lit("too short"), e["key"], F.length(text(e["value"]))))
    return F.when(F.size("entries") == 0, F.array(_error(F.lit("empty record")))).otherwise(found)


def _consistency() -> Column:
    keys = F.map_keys("entries")
    kinds = {"missing keys": F.array_except("reference", keys), "extra keys": F.array_except(keys, F.col("reference"))}
    found = [F.when((F.col("idx") > F.col("at")) & (F.size(diff) > 0), _error(F.lit(kind), None, F.array_join(F.array_sort(diff), ", "))) for kind, diff in kinds.items()]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def _with_reference(records: DataFrame) -> DataFrame:
    """``parsed`` with the keys of the first record and its position: one row, broadcast; only that one is parsed for it."""
    first = records.agg(F.min_by("record", "idx").alias("record"), F.min("idx").alias("idx"))
    return parsed(records).crossJoin(F.broadcast(parsed(first).select(F.map_keys("entries").alias("reference"), F.col("idx").alias("at"))))


def _rows(df: DataFrame, found: Column) -> DataFrame:
    return df.select("idx", F.explode(found).alias("e")).select("idx", "e.kind", "e.key", "e.detail")


def _unknown(records: DataFrame, fmt: str) -> DataFrame:
    return records.sparkSession.createDataFrame([(None, "unknown format", None, fmt)], "idx long, kind string, key string, detail string")


def schema_errors(records: DataFrame, fmt: str) -> DataFrame:
    """(idx, kind, key, detail): 'missing' or 'empty' required keys; an unknown format is one error without a record."""
    return _rows(parsed(records), _schema(fmt)) if fmt in REQUIRED else _unknown(records, fmt)


def completeness_errors(records: DataFrame) -> DataFrame:
    """Records without keys, and strings (but ``metadata``) that are shorter than 5 characters when stripped; detail has the unstripped length."""
    return _rows(parsed(records), _completeness())


def consistency_errors(records: DataFrame) -> DataFrame:
    """Records whose keys differ from those of the first: 'missing keys' and 'extra keys', sorted, in detail."""
    return _rows(_with_reference(records), _consistency())


def _warned() -> Column:
    m = F.try_element_at("entries", F.lit("metadata"))
    return F.map_contains_key("entries", "metadata") & ~F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False))


def lineage_warnings(records: DataFrame) -> DataFrame:
    """Records with ``metadata`` that isn't an object."""
    return _rows(parsed(records).where(_warned()), F.array(_error(F.lit("metadata is no object"), F.lit("metadata"))))


def errors(records: DataFrame, fmt: str) -> DataFrame:
    """The errors of all three checks, from one pass over the records."""
    if fmt not in REQUIRED:
        return _unknown(records, fmt).unionByName(_rows(_with_reference(records), F.concat(_completeness(), _consistency())))
    return _rows(_with_reference(records), F.concat(_schema(fmt), _completeness(), _consistency()))


def report(records: DataFrame, fmt: str) -> DataFrame:
    """(total, valid, errors, warnings, pass_rate), counted in one pass; positions are distinct."""
    known = fmt in REQUIRED
    checks = F.concat(_schema(fmt), _completeness(), _consistency()) if known else F.concat(_completeness(), _consistency())
    rows = _with_reference(records).select(F.size(checks).alias("n"), _warned().alias("warned"))
    one = rows.agg(F.count("*").alias("total"), (F.coalesce(F.sum("n"), F.lit(0)) + (0 if known else 1)).alias("errors"), F.count_if(F.col("n") > 0).alias("bad"), F.count_if("warned").alias("warnings"))
    valid = F.col("total") - F.col("bad")
    return one.select("total", valid.alias("valid"), "errors", "warnings", F.when(F.col("total") > 0, F.round(valid / F.col("total"), 4)).otherwise(0.0).alias("pass_rate"))
