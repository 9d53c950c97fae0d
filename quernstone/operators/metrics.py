"""Diversity, benchmark report, cost ledger, gates, counters."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.sources.shared import checkpointed


# ---- diversity of samples (subtopic, difficulty, question) ----


def topic_entropy(samples: DataFrame, by: str = "subtopic") -> DataFrame:
    """(topic_entropy): of the topics' shares, over the log of how many there are; 0 for one topic or sample."""
    counts = samples.groupBy(F.coalesce(by, F.lit("unknown")).alias("t")).agg(F.count("*").cast("double").alias("c"))
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    h = (F.log2("n") - F.col("s") / F.col("n")) / F.log2(F.col("k").cast("double"))
    return sums.select(F.when((F.col("n") > 1) & (F.col("k") > 1), h).otherwise(0.0).alias("topic_entropy"))


def difficulty_balance(samples: DataFrame, by: str = "difficulty") -> DataFrame:
    """(difficulty_balance): 1 less the levels' deviation over their mean, within [0, 1]; 0.5 for a single level."""
    counts = samples.groupBy(F.coalesce(by, F.lit("intermediate")).alias("d")).agg(F.count("*").alias("c"))
    stats = counts.agg(F.count("*").alias("k"), (1 - F.stddev_pop("c") / F.avg("c")).alias("b"))
    return stats.select(F.when(F.col("k") == 0, 0.0).when(F.col("k") == 1, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "b"))).alias("difficulty_balance"))


def prompt_uniqueness(samples: DataFrame, by: str = "question") -> DataFrame:
    """(prompt_uniqueness): distinct first 50 characters, in lower case, of the samples' prompts over all samples."""
    key = F.trim(F.lower(F.substring(F.coalesce(by, F.lit("")), 1, 50)))
    return samples.agg(F.when(F.count("*") > 0, F.countDistinct(key) / F.count("*")).otherwise(0.0).alias("prompt_uniqueness"))


def diversity(samples: DataFrame) -> DataFrame:
    """(topic_entropy, difficulty_balance, prompt_uniqueness, overall), rounded to 4 places; overall is the mean of the unrounded ones."""
    one = topic_entropy(samples).crossJoin(difficulty_balance(samples)).crossJoin(prompt_uniqueness(samples))
    names = ["topic_entropy", "difficulty_balance", "prompt_uniqueness"]
    return one.select(*[F.round(n, 4).alias(n) for n in names], F.round((F.col(names[0]) + F.col(names[1]) + F.col(names[2])) / 3, 4).alias("overall"))


# ---- benchmark ----


def benchmark(samples: DataFrame) -> DataFrame:
    """(total, accepted, rejected, pass_rate, avg_quality) of samples with verdict and quality_score."""
    n = F.count("*")
    accept = F.count_if(F.coalesce(F.col("verdict") == "accept", F.lit(False)))
    reject = F.count_if(F.coalesce(F.col("verdict") == "reject", F.lit(False)))
    rate = F.when(n > 0, F.round(accept / n, 4)).otherwise(0.0)
    return samples.agg(n.alias("total"), accept.alias("accepted"), reject.alias("rejected"), rate.alias("pass_rate"), F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 4).alias("avg_quality"))


def failure_reasons(samples: DataFrame) -> DataFrame:
    """(reason, samples): issues of samples with another verdict than accept, cut to 80 characters."""
    rows = samples.where("verdict IS NOT NULL AND verdict <> 'accept'").select(F.explode("issues").alias("issue"))
    return rows.groupBy(F.substring("issue", 1, 80).alias("reason")).agg(F.count("*").alias("samples"))


# ---- ledger: (seq, stage, model, tokens_in, tokens_out, cost) ----


def cost_by(ledger: DataFrame, *by: str) -> DataFrame:
    """Totals by the columns; rows with an empty one aren't in any total."""
    return ledger.where(" AND ".join(f"coalesce(`{c}`, '') <> ''" for c in by)).groupBy(*by).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


def cost_rollup(ledger: DataFrame) -> DataFrame:
    """(stage, model, calls, cost) with totals by stage and in all, where the columns are null."""
    return ledger.rollup("stage", "model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def running(ledger: DataFrame, limit: float | None = None, order: list[str] | None = None) -> DataFrame:
    """``ledger`` with ``spent``, the cost up to and with each row, ``remaining`` and ``over`` (spent is over the limit).

    A running total over one order is sequential; to keep it parallel rows are cut into ranges of the whole order, of about
    equal numbers of rows however many share a time: totals of ranges, a row for each task, run up first and each range then
    adds its own running total. The ranges are checkpointed, so that both see the same ones.
    """
    order = order or ["ts", "seq"]
    marked = checkpointed(ledger.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(F.col("__b").alias("b")).agg(F.sum("cost").alias("s")).select("b", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("__start"))
    own = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.col("__start") + F.sum("cost").over(own)
    out = marked.join(F.broadcast(starts), F.col("__b") == F.col("b")).withColumn("spent", spent)  # a row for each range
    ceiling = F.lit(float(limit)) if limit is not None else F.lit(None).cast("double")
    return out.select(*ledger.columns, "spent", F.greatest(F.lit(0.0), ceiling - F.col("spent")).alias("remaining"), F.coalesce(F.col("spent") > ceiling, F.lit(False)).alias("over"))


def first_breach(ledger: DataFrame, limit: float, order: list[str] | None = None) -> DataFrame:
    """The first row by which the limit is exceeded, with what is spent by then; none if it never is."""
    order = order or ["ts", "seq"]
    return running(ledger, limit, order).where("over").orderBy(*order).limit(1)


class BudgetExceeded(RuntimeError):
    def __init__(self, spent, limit, stage=""):
        super().__init__(f"budget exceeded: {spent:.4f} of {limit:.4f}" + (f" in {stage}" if stage else ""))
        self.spent, self.limit, self.stage = spent, limit, stage


class Budget:
    """The driver's ledger: usage is recorded first, then the limit is checked (strictly over it is an error)."""

    def __init__(self, limit: float | None = None, warn_at: float = 0.8):
        self.limit, self.warn_at, self.rows, self.spent = limit, warn_at, [], 0.0

    def record(self, tokens_in: int, tokens_out: int, model: str, cost: float, stage: str = "") -> None:
        self.rows.append((len(self.rows), stage, model, tokens_in, tokens_out, float(cost)))
        self.spent += cost
        if self.limit is not None and self.spent > self.limit:
            raise BudgetExceeded(self.spent, self.limit, stage)

    @property
    def remaining(self) -> float | None:
        return None if self.limit is None else max(0.0, self.limit - self.spent)

    @property
    def warning(self) -> bool:
        return self.limit is not None and self.spent >= self.warn_at * self.limit

    def ledger(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "seq long, stage string, model string, tokens_in long, tokens_out long, cost double")


# ---- gates ----


@dataclass(frozen=True)
class Limits:
    max_duplicate_rate: float = 0.10
    min_diversity: float = 0.5
    min_verification: float = 0.6
    max_cost: float | None = None


def gates(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(gate, passed, actual, threshold) for a row (total, duplicates, diversity, pass_rate, cost), compared as they are given."""
    rate = F.when(F.col("total") > 0, F.col("duplicates") / F.col("total")).otherwise(0.0)
    cost = F.lit(limits.max_cost).cast("double")
    rows = [
        F.struct(F.lit("duplicates").alias("gate"), (rate <= limits.max_duplicate_rate).alias("passed"), rate.alias("actual"), F.lit(limits.max_duplicate_rate).cast("double").alias("threshold")),
        F.struct(F.lit("diversity").alias("gate"), (F.col("diversity") >= limits.min_diversity).alias("passed"), F.col("diversity").cast("double").alias("actual"), F.lit(limits.min_diversity).cast("double").alias("threshold")),
        F.struct(F.lit("verification").alias("gate"), (F.col("pass_rate") >= limits.min_verification).alias("passed"), F.col("pass_rate").cast("double").alias("actual"), F.lit(limits.min_verification).cast("double").alias("threshold")),
        F.struct(F.lit("budget").alias("gate"), F.coalesce(F.col("cost") <= cost, F.lit(True)).alias("passed"), F.col("cost").cast("double").alias("actual"), cost.alias("threshold")),
    ]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.gate", "g.passed", F.round("g.actual", 4).alias("actual"), "g.threshold")


def failed_gates(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return gates(metrics, limits).where("NOT passed")


class GateFailed(RuntimeError):
    def __init__(self, failed: list):
        super().__init__("gates failed: " + ", ".join(f["gate"] for f in failed))
        self.failed = failed


# ---- the driver's counters ----


class Collector:
    """Counters, gauges and timers of a run; safe to use from several threads."""

    def __init__(self):
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.counters, self.gauges, self.seconds, self.costs = defaultdict(int), {}, defaultdict(float), defaultdict(float)

    def increment(self, name: str, by: int = 1) -> None:
        with self._lock:
            self.counters[name] += by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self.gauges[name] = value

    def record_cost(self, model: str, cost: float) -> None:
        with self._lock:
            self.costs[model] += cost

    @contextmanager
    def timer(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            with self._lock:
                self.seconds[name] += time.perf_counter() - began

    def snapshot(self) -> dict:
        with self._lock:
            return {"counters": dict(self.counters), "gauges": dict(self.gauges), "seconds": dict(self.seconds), "cost": sum(self.costs.values()), "cost_by_model": dict(self.costs)}
