"""A key-value store of JSON documents in Parquet, run states, and blobs."""

from __future__ import annotations

import os
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCHEMA = "collection string, doc_id string, data string, version long, deleted boolean"


class Storage(Protocol):
    """Documents of collections as (doc_id, data), states of runs, and blobs; lists, loads, saves and deletes them."""

    def documents(self, collection): ...
    def save(self, collection, rows): ...
    def load(self, collection, doc_id): ...
    def list(self, collection): ...
    def delete(self, collection, doc_id): ...
    def load_state(self, run_id): ...
    def save_state(self, run_id, state): ...
    def load_blob(self, name): ...
    def save_blob(self, name, data): ...


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: upserts are appended and resolved when read."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("__n = 1").drop("__n")


class ParquetStore:
    """Appends versions, partitioned by collection; reading takes the last of each key. ``compact`` drops older ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self, collection: str) -> DataFrame:
        at = f"{self.path}/documents/{collection}"
        if not self._exists(at):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.parquet(at).withColumn("collection", F.lit(collection)).select(*[c.split()[0] for c in _SCHEMA.split(", ")])

    def _exists(self, at: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _append(self, collection: str, rows: DataFrame, deleted: bool) -> None:
        top = self._all(collection).agg(F.max("version")).first()[0] or 0
        rows.select("doc_id", "data", F.lit(top + 1).cast("long").alias("version"), F.lit(deleted).alias("deleted")).write.mode("append").parquet(f"{self.path}/documents/{collection}")

    def save(self, collection: str, rows: DataFrame) -> None:
        """``rows`` are (doc_id, data); data is JSON text. A key that is there already is replaced."""
        self._append(collection, rows, False)

    def documents(self, collection: str) -> DataFrame:
        return latest(self._all(collection), ["doc_id"], ["version"]).where("NOT deleted").select("doc_id", "data")

    def load(self, collection: str, doc_id: str) -> str | None:
        row = latest(self._all(collection).where(F.col("doc_id") == doc_id), ["doc_id"], ["version"]).where("NOT deleted").first()
        return row["data"] if row else None

    def list(self, collection: str) -> list[str]:
        return [r["doc_id"] for r in self.documents(collection).select("doc_id").orderBy("doc_id").collect()]

    def delete(self, collection: str, doc_id: str) -> None:
        self._append(collection, self.spark.createDataFrame([(doc_id, None)], "doc_id string, data string"), True)

    def save_state(self, run_id: str, state: str) -> None:
        self.save("__state", self.spark.createDataFrame([(run_id, state)], "doc_id string, data string"))

    def load_state(self, run_id: str) -> str | None:
        return self.load("__state", run_id)

    def _blob(self, name: str) -> str:
        root = os.path.realpath(os.path.join(self.path, "blobs"))
        at = os.path.realpath(os.path.join(root, name))
        if not at.startswith(root + os.sep):
            raise ValueError(f"'{name}' leaves the store")
        return at

    def save_blob(self, name: str, data: bytes) -> str:
        at = self._blob(name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(tmp := f"{at}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(tmp, at)
        return at

    def load_blob(self, name: str) -> bytes:
        with open(self._blob(name), "rb") as f:
            return f.read()

    def blobs(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/blobs")
