"""Mixing sources to target weights by capped water-filling.

Each source's share of the budget is its weight times one common level, but at most ``max_epochs`` times its size: sources
at this limit are clamped and what they can't take goes to the others in proportion to their weights, until no source
exceeds its limit. With sources sorted by limit / weight the clamped ones are a prefix, so the fixed point is found by one
pass of running sums over the table of sources. A source's epochs are its share over its size: every document is
repeated the whole part of them, and once more where the seeded hash of its id is under the fraction.

Sizes are characters over all documents. Nothing but a row for each source is gathered, and checkpointed; where there are at most
``MAX_BROADCAST`` sources they are broadcast and documents stay in place, else documents are joined over ``SALTS`` parts of each source.

Defined results: a null source is a source of its own; a null or empty text has size 0 and is repeated like the others of its
source; a source of size 0 has 0 epochs; sources without a target weight get weight 0 where weights are given, else all
weights are equal; weights, epochs or a budget that are negative or no number are an error; a budget beyond what max_epochs allows is
cut down to it; sources that tie in limit / weight are clamped together; a very long text counts with all its characters; repeated
rows have equal hashes and so equal repetitions; an empty table gives an empty result; extra columns, whatever their names, pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm._common import checkpointed, unit_hash

MAX_EPOCHS, SEED = 4.0, 7
MAX_BROADCAST, SALTS = 100_000, 64


def shares(docs: DataFrame, weights: dict[str, float] | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(source, docs, size, weight, allocated, epochs): one row for each source; ``budget`` defaults to the corpus's size."""
    if any(not x >= 0 or math.isinf(x) for x in [*(weights or {}).values(), max_epochs, budget or 0.0]):
        raise ValueError("weights, epochs and budget have to be finite and not negative")
    sized = docs.groupBy("source").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.coalesce("source", F.lit(""))], F.lit(0.0)) if weights else F.lit(0.0)
    everything = Window.partitionBy()
    able = sized.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0)).withColumn("cap", F.when(F.col("weight") > 0, F.col("size") * F.lit(float(max_epochs))).otherwise(0.0))
    total = F.least(F.sum("cap").over(everything), F.lit(float(budget)) if budget is not None else F.sum("size").over(everything).cast("double"))
    ranked = able.withColumn("total", total).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", F.when(F.col("weight") > 0, level))
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    taken = F.when(F.col("weight") > 0, F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))).otherwise(0.0)
    out = leveled.withColumn("allocated", taken)
    return out.select("source", "docs", "size", "weight", "allocated", F.when(F.col("size") > 0, F.col("allocated") / F.col("size")).otherwise(0.0).alias("epochs"))


def _times(seed: int) -> Column:
    whole = F.floor("__epochs")
    return (whole + (unit_hash(F.coalesce("doc_id", F.lit(-1)), seed=seed) < F.col("__epochs") - whole).cast("long")).cast("int")


def _joined(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, row, __epochs): each row as a struct, so that no name of its columns can clash, with its source's epochs."""
    own = docs.select("doc_id", F.col("source").alias("__own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    plan = checkpointed(plan.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs")))
    same = F.col("__own").eqNullSafe(F.col("__source"))
    if plan.count() <= MAX_BROADCAST:
        return own.join(F.broadcast(plan), same).drop("__own", "__source")
    # Any part of a source gives the same result; which one a row takes follows from where it is read.
    salted = own.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = plan.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(parts, same & (F.col("__salt") == F.col("__part"))).drop("__own", "__source", "__salt", "__part")


def repetitions(docs: DataFrame, weights: dict[str, float] | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, repetitions, epochs): every document with how often the mix holds it, 0 included."""
    narrow = docs.select("doc_id", "source")
    return _joined(narrow, shares(docs, weights, max_epochs, budget)).select("doc_id", "row.source", _times(seed).alias("repetitions"), F.round("__epochs", 6).alias("epochs"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix holds it."""
    timed = _joined(docs, shares(docs, weights, max_epochs, budget)).withColumn("__times", _times(seed))
    return timed.where("__times > 0").withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select("row.*")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT source, count(*) AS docs, coalesce(sum(length(text)), 0) AS size FROM documents GROUP BY source),
able AS (
  SELECT source, size, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0 END AS weight, CASE WHEN size > 0 THEN size * {MAX_EPOCHS}::DOUBLE ELSE 0 END AS cap FROM sized),
ranked AS (
  SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 0 END AS ratio, least((SELECT sum(cap) FROM able), (SELECT sum(size)::DOUBLE FROM able)) AS total FROM able),
leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
plan AS (
  SELECT source, CASE WHEN size > 0 THEN least(cap, coalesce((SELECT max(level) FROM leveled WHERE weight > 0 AND level <= ratio), 'infinity'::DOUBLE) * weight) / size ELSE 0 END AS epochs FROM leveled)
SELECT d.doc_id, d.source,
  (floor(p.epochs) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id, -1)::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 < p.epochs - floor(p.epochs) THEN 1 ELSE 0 END)::INTEGER AS repetitions,
  round(p.epochs, 6) AS epochs
FROM documents d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
"""
