"""Generation: plans, their expansion into cells, context samples, model texts to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import consistency, formats
from quernstone.sources.shared import checkpointed

DIFFICULTIES = [("beginner", 3), ("intermediate", 4), ("advanced", 3)]
_PLAN = "struct<name: string, concepts: array<string>, sample_count: int, difficulties: map<string,int>>"


def excerpts(chunks: DataFrame, per_doc: int = 2, chars: int = 500, most: int = 20) -> DataFrame:
    """(excerpts): the beginnings of the first chunks (doc_id, pos, chunk) of the first documents, joined; the limits are the feature."""
    cut = chunks.where(F.col("pos") < per_doc).orderBy("doc_id", "pos").limit(most).select("doc_id", "pos", F.substring("chunk", 1, chars).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "pos", "t")))
    return cut.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n---\n").alias("excerpts"))


def parse_plan(responses: DataFrame) -> DataFrame:
    """(topic, plan_pos, name, concepts, sample_count, difficulties) from model texts (topic, text); defaults where they can't be read."""
    r = F.from_json(T.strip_fence(F.col("text")), f"generation_plan array<{_PLAN}>")["generation_plan"]
    fallback = F.array(F.struct(F.col("topic").alias("name"), F.array("topic").alias("concepts"), F.lit(10).alias("sample_count"), F.lit(None).cast("map<string,int>").alias("difficulties")))
    rows = responses.select("topic", F.posexplode(F.coalesce(F.when(F.size(r) > 0, r), fallback)).alias("plan_pos", "p"))
    default = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("cnt")) for k, n in DIFFICULTIES])
    own = F.transform(F.map_entries("p.difficulties"), lambda e: F.struct(e["key"].alias("level"), e["value"].alias("cnt")))
    return rows.select("topic", "plan_pos", "p.name", F.coalesce("p.concepts", F.array().cast("array<string>")).alias("concepts"), F.coalesce("p.sample_count", F.lit(10)).alias("sample_count"), F.coalesce(own, default).alias("difficulties"))


def expand(plan: DataFrame, max_samples: int = 100, batch_size: int = 10) -> DataFrame:
    """(plan_pos, name, concept_pos, concept, level_pos, level, wanted, batch): one row for each cell of the plan, in order.

    A cell's batch is what its level wants, at most ``batch_size``, until the target is reached; a level that wants nothing
    ends its concept's levels. This is the closed form for when every answer is usable; run it again on what is missing
    where some aren't. The order is cut into ranges of rows, checkpointed so that both passes see the same ones: the ranges' sums,
    a row for each, run up first, and each range then adds its own running sum.
    """
    concepts = F.when(F.size("concepts") > 0, F.col("concepts")).otherwise(F.array("name"))
    cells = plan.select("plan_pos", "name", F.posexplode(concepts).alias("concept_pos", "concept"), "difficulties")
    cells = cells.select("plan_pos", "name", "concept_pos", "concept", F.posexplode("difficulties").alias("level_pos", "d"))
    wanted = F.least(F.col("d.cnt"), F.lit(batch_size))
    levels = Window.partitionBy("plan_pos", "concept_pos").orderBy("level_pos").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("open", F.min(F.when(wanted > 0, 1).otherwise(0)).over(levels)).withColumn("wanted", F.when(F.col("open") == 1, wanted).otherwise(0))
    target = plan.agg(F.least(F.lit(max_samples), F.coalesce(F.sum("sample_count"), F.lit(0))).alias("target"))
    keys = ["plan_pos", "concept_pos", "level_pos"]
    ranged = checkpointed(cells.select("plan_pos", "name", "concept_pos", "concept", "level_pos", "d", "wanted").repartitionByRange(*keys).withColumn("__b", F.spark_partition_id()))
    ranges = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col("__b").alias("b")).agg(F.sum("wanted").alias("n")).select("b", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("start"))
    order = Window.partitionBy("__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("wanted").over(order), F.lit(0))
    out = ranged.join(F.broadcast(starts), F.col("__b") == F.col("b")).crossJoin(F.broadcast(target)).withColumn("batch", F.greatest(F.lit(0), F.least(F.col("wanted"), F.col("target") - before)).cast("int"))
    return out.select("plan_pos", "name", "concept_pos", "concept", "level_pos", F.col("d.level").alias("level"), F.col("wanted").cast("int").alias("wanted"), "batch")


def context_sample(cells: DataFrame, chunks: DataFrame, key: list[str], n: int = 3, seed: int = 42) -> DataFrame:
    """(key..., context, source_ids): for each cell ``n`` different chunks (doc_id, pos, chunk), fewer where there are fewer, drawn
    for each cell on its own.

    Each cell draws ``n`` of the places of a shuffled table of chunks by a seeded hash; cells may meet. Only which draws are
    equal matters to a shuffled order, so the drawn places are renumbered from 0 without gaps and only as many chunks as there
    are numbers are taken, those with the least seeded hashes: a top-k over (hash, doc_id, pos), to which texts are joined. Text
    and source are drawn together, so a sample's sources are where its context came from.
    """
    hashed = chunks.select("doc_id", "pos", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("pos").cast("string"))).alias("h"))
    size = hashed.count()
    if not size:
        return cells.select(*key, F.lit("").alias("context"), F.array().cast("array<bigint>").alias("source_ids")).limit(0)
    take = min(n, size)

    def draw(have, k):
        most = F.lit(size - take).cast("long") + k  # of the places up to here one that isn't taken, or else this one
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key], k.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
        place = F.floor(u * (most + 1)).cast("long")
        return F.array_append(have, F.when(F.array_contains(have, place), most).otherwise(place))

    drawn = cells.select(*key).distinct().withColumn("places", F.aggregate(F.sequence(F.lit(0), F.lit(take - 1)), F.array().cast("array<bigint>"), draw))
    dealt = drawn.select(*key, F.posexplode("places").alias("k", "place")).withColumn("rank", F.dense_rank().over(Window.orderBy("place")) - 1)
    need = (dealt.agg(F.max("rank")).first()[0] or 0) + 1  # a plan's cells are few
    pool = hashed.orderBy("h", "doc_id", "pos").limit(need).withColumn("rank", F.row_number().over(Window.orderBy("h", "doc_id", "pos")) - 1)
    texts = dealt.join(pool.select("rank", "doc_id", "pos"), "rank").join(chunks, ["doc_id", "pos"])
    items = F.array_sort(F.collect_list(F.struct("k", "doc_id", "chunk")))
    return texts.groupBy(*key).agg(items.alias("i")).select(*key, F.array_join(F.transform("i", lambda x: x["chunk"]), "\n\n").alias("context"), F.transform("i", lambda x: x["doc_id"]).alias("source_ids"))


def build_prompts(cells: DataFrame, contexts: DataFrame, fmt: str, key: list[str]) -> DataFrame:
    """``cells`` with context, source_ids, system and prompt."""
    joined = cells.join(contexts, key, "left")
    return joined.withColumn("system", F.lit(formats.SYSTEM[formats.known(fmt)])).withColumn("prompt", formats.prompt(fmt, F.col("concept"), F.coalesce("context", F.lit("")), F.col("level")))


def to_samples(responses: DataFrame, fmt: str, run_id: str = "") -> DataFrame:
    """Samples from model texts (call_id, model, text, concept, name, level, source_ids): content, validity and lineage."""
    fmt = formats.known(fmt)
    record = formats.parse(fmt, F.col("text"), F.col("concept"), F.col("name"), F.col("level"))
    rows = responses.withColumn("content", F.parse_json(record)).withColumn("valid", formats.is_filled(fmt, F.col("content")))
    lineage = F.struct(
        F.col("call_id").cast("string").alias("sample_id"), F.col("source_ids").alias("source_documents"), F.col("model").alias("generation_model"),
        F.current_timestamp().alias("generation_timestamp"), F.col("name").alias("template"), F.lit(run_id).alias("pipeline_run_id"), F.lit(fmt).alias("format"),
        F.create_map(F.lit("generate"), F.lit("1.0")).alias("stage_versions"),
    )
    return rows.select(F.col("call_id").alias("sample_id"), F.lit(fmt).alias("format"), "content", "valid", lineage.alias("lineage"), F.col("name").alias("subtopic"), F.col("level").alias("difficulty"))


def self_consistent(responses: DataFrame, fmt: str, run_id: str = "") -> DataFrame:
    """The winning sample of each prompt from several texts (prompt_id, pos, ...); ``agreement_ratio`` is a column.

    ``programmatic_pass`` of the responses is used where they have it.
    """
    passed = F.col("programmatic_pass") if "programmatic_pass" in responses.columns else F.lit(None).cast("boolean")
    samples = to_samples(responses, fmt, run_id).where("valid")
    ids = responses.select(F.col("call_id").alias("sample_id"), "prompt_id", "pos", passed.alias("programmatic_pass"))
    joined = samples.join(ids, "sample_id")
    candidates = joined.select("prompt_id", "pos", F.col("sample_id").cast("string").alias("candidate_id"), consistency.answer_signature(F.col("content"), F.col("format")).alias("answer_signature"), "programmatic_pass", *[c for c in samples.columns])
    return consistency.selected(candidates).drop("answer_signature", "candidate_id")
