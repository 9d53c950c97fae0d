"""The refine loop: rows that need revision are rewritten and judged again, for a bounded number of rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.shared import checkpointed


def refine(samples: DataFrame, rewrite: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame, int], DataFrame], max_retries: int = 2, id_col: str = "sample_id") -> DataFrame:
    """``samples`` with their final verdict and ``attempt``, the last round that rewrote them (0: none).

    ``rewrite(open, attempt)`` gives the rewritten rows (those it leaves out failed and stay as they are); ``judge(rows,
    attempt)`` gives (id, verdict) and fresh values of any other columns of ``samples`` that it has. A row leaves the loop when its verdict isn't 'revise' any more; none is accepted just
    because rounds are used up. Each round is checkpointed: rewriting may call a model and must not run twice.
    """
    columns = samples.columns
    done = samples.where("verdict IS NULL OR verdict <> 'revise'").withColumn("attempt", F.lit(0))
    left = samples.where("verdict = 'revise'").withColumn("attempt", F.lit(0))
    for attempt in range(1, max(1, max_retries) + 1):
        rewritten = rewrite(left, attempt).select(*columns, F.lit(attempt).alias("attempt"))
        judged = judge(rewritten, attempt)
        judged = judged.select(id_col, *[x for x in judged.columns if x in columns and x != id_col])
        fresh = rewritten.drop(*[x for x in judged.columns if x != id_col]).join(judged, id_col)
        fresh = checkpointed(fresh.select(*columns, "attempt"))
        rest = left.join(fresh.select(id_col), id_col, "left_anti").select(*columns, "attempt")
        done = done.unionByName(fresh.where("verdict <> 'revise'"))
        left = rest.unionByName(fresh.where("verdict = 'revise'"))
        if left.isEmpty():
            break
    return done.unionByName(left)
