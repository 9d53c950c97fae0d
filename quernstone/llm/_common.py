"""Helpers that several operators share: text to arrays, reliable checkpoints, table access, seeded hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this repository, also where only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where that is unset and all run on this machine, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quernstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_files(spark: SparkSession, label: str) -> str:
    """A new local-path folder inside the shared folder, for files that executors memory-map."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {at.scheme}://")
    path = os.path.join(at.path, f"{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, run: Callable, schema: str, id_col: str = "doc_id") -> DataFrame:
    """``df.mapInPandas(run, schema)`` without frames that have no rows; the id, a long and first in both, is text within ``run``, as pandas would round long ids beside nulls."""
    names = [x for x in df.columns if x != id_col]
    out = df.select(F.col(id_col).cast("string").alias(id_col), *names).mapInPandas(lambda frames: run(f for f in frames if len(f)), schema.replace(f"{id_col} long", f"{id_col} string", 1))
    return out.withColumn(id_col, F.col(id_col).cast("long"))


def unit_hash(*cols: Column, seed: int) -> Column:
    """A double in [0, 1) from MD5 of the seed and the columns: 52 bits, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def text_groups(texts: list, max_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``max_chars`` together; a longer text has a range of its own. None counts as empty."""
    at = chars = 0
    for k, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if k > at and chars + n > max_chars:
            yield at, k
            at, chars = k, 0
        chars += n
    if at < len(texts):
        yield at, len(texts)


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array, each ended by a 0, and the position of the text of each code point."""
    joined = "\0".join(t or "" for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    return codes, np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
