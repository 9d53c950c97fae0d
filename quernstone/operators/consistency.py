"""Self-consistency: candidates of a prompt are grouped by answer signature, the largest group's answer wins.

Candidates are rows (prompt_id, pos, candidate_id, answer_signature, programmatic_pass); pos orders them. One that failed
its programmatic check is out, one that wasn't checked (null) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

SIGNATURE_KEYS = dict(agent="result", chat="conversations", coding="patch", instruction="messages", reasoning="answer")


def answer_signature(content: Column, fmt: Column, keys: dict[str, str] = SIGNATURE_KEYS) -> Column:
    """The normalised answer of a JSON record (variant); lists are joined by blanks, objects in them as JSON.

    A format without a key of its own uses ``answer``; pass ``keys`` with ``principles='solution'`` to cover that format.
    """
    def of(key: str) -> Column:
        value = F.variant_get(content, f"$.{key}", "variant")
        items = F.variant_get(value, "$", "array<variant>")
        listed = F.array_join(F.transform(items, lambda x: F.variant_get(x, "$", "string")), " ")
        return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(F.variant_get(value, "$", "string"))

    raw = of("answer")
    for name, key in keys.items():
        raw = F.when(fmt == name, of(key)).otherwise(raw)
    return T.normalize_answer(F.coalesce(raw, F.lit("")))


def survivors(candidates: DataFrame) -> DataFrame:
    return candidates.where("programmatic_pass IS DISTINCT FROM false")


def clusters(candidates: DataFrame) -> DataFrame:
    """(prompt_id, answer_signature, cluster_id, size, first_pos): clusters by size, ties by first appearance."""
    sized = survivors(candidates).groupBy("prompt_id", "answer_signature").agg(F.count("*").alias("size"), F.min("pos").alias("first_pos"))
    rank = Window.partitionBy("prompt_id").orderBy(F.desc("size"), "first_pos")
    return sized.withColumn("cluster_id", F.row_number().over(rank) - 1).select("prompt_id", "answer_signature", "cluster_id", "size", "first_pos")


def winners(candidates: DataFrame) -> DataFrame:
    """(prompt_id, selected_id, rejected_ids, agreement_ratio): one row for each prompt.

    All of a prompt's rows are combined in two grouped passes over the same key, so they are shuffled once.
    """
    alive = F.expr("programmatic_pass IS DISTINCT FROM false")
    member = F.struct(F.coalesce(~F.col("programmatic_pass"), F.lit(True)).alias("unconfirmed"), "pos", "candidate_id")
    grouped = candidates.groupBy("prompt_id", "answer_signature").agg(
        F.count_if(alive).alias("size"), F.min(F.when(alive, F.col("pos"))).alias("first_pos"), F.min(F.when(alive, member)).alias("best"),
        F.collect_list(F.when(alive, F.struct("pos", "candidate_id"))).alias("members"),
    )
    key = F.struct((-F.col("size")).alias("minus"), F.col("first_pos"))
    prompts = grouped.groupBy("prompt_id").agg(F.sum("size").alias("n"), F.max("size").alias("top"), F.min_by("best", F.when(F.col("size") > 0, key)).alias("best"), F.flatten(F.collect_list("members")).alias("members"))
    selected = F.when((F.col("n") == 1) | (F.col("top") >= 2), F.col("best.candidate_id"))
    ordered = F.transform(F.array_sort("members"), lambda m: m["candidate_id"])
    rejected = F.when(F.col("n") > 1, F.filter(ordered, lambda c: ~c.eqNullSafe(F.col("selected_id")))).otherwise(F.array().cast("array<string>"))
    picked = prompts.withColumn("selected_id", selected)
    return picked.select("prompt_id", "selected_id", rejected.alias("rejected_ids"), F.when(F.col("n") > 0, F.col("top") / F.col("n")).otherwise(0.0).alias("agreement_ratio"))


def selected(candidates: DataFrame) -> DataFrame:
    """The winning candidate rows, with ``agreement_ratio``; prompts without a winner are left out."""
    won = winners(candidates).where("selected_id IS NOT NULL").select("prompt_id", F.col("selected_id").alias("candidate_id"), "agreement_ratio")
    return candidates.join(won, ["prompt_id", "candidate_id"])


_NUMBER = r"^[-+]?\d*\.?\d+(/\d+)?$"


def math_pass(answer: Column, reference: Column) -> Column:
    """Whether the first numbers of two texts are equal as fractions or decimals; null where either isn't a number."""
    def exact(t: Column) -> tuple[Column, Column]:
        n = T.first_number(t)
        ok = n.rlike(_NUMBER)
        top = F.when(ok, F.split(n, "/")[0].try_cast("decimal(38,10)"))
        return top, F.when(ok, F.coalesce(F.try_element_at(F.split(n, "/"), F.lit(2)).try_cast("decimal(19,0)"), F.lit(1).cast("decimal(19,0)")))

    (a, b), (c, d) = exact(answer), exact(reference)
    return F.when((b != 0) & (d != 0), a.cast("double") * d.cast("double") == c.cast("double") * b.cast("double"))
