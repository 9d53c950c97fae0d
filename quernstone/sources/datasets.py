"""JSONL and Parquet datasets: reading with bad lines set apart, writing, exact splits, export with metadata."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import file_stem, strip
from quernstone.sources.shared import checkpointed


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record, ok): the lines of a JSONL file, or of a folder's ``*.jsonl`` files, that aren't blank.

    ``file`` is the whole path, ``line`` the line's number in it from 1, blank lines included. A line is ok when it is JSON. A
    missing path is an error. Files are read in blocks: lines are numbered within each, and the blocks' sizes, a row for each,
    run up by file.
    """
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(path) if not path.endswith(".jsonl") else spark.read.text(path)
    # Numbers rise by one within a block, which one task reads from its begin to its end.
    numbered = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), strip(F.col("value")).alias("record"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    lines = numbered.where("record <> ''").join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first") + 1).alias("line"), "record")
    return lines.withColumn("ok", F.try_parse_json("record").isNotNull())


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record) of the good lines; bad ones are left out (``bad_lines`` has them)."""
    return read_lines(spark, path).where("ok").drop("ok")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).where("NOT ok").drop("ok")


def from_directory(spark: SparkSession, path: str) -> DataFrame:
    """The good lines of all ``*.jsonl`` files of a folder in the order of (file, line): tasks hold ranges of it, each sorted."""
    return from_jsonl(spark, path).orderBy("file", "line")


def indexed(records: DataFrame) -> DataFrame:
    """(idx, record): positions from 0 in the order of (file, line).

    Counted by ranges of (file, line) and running up within each, so that one large file isn't one task's."""
    ranged = checkpointed(records.repartitionByRange("file", "line").withColumn("__b", F.spark_partition_id()))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col("__b").alias("b")).agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy("file", "line")) - 1
    return ranged.join(F.broadcast(starts), F.col("__b") == F.col("b")).select((F.col("start") + own).alias("idx"), "record")  # a row for each range


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_json(df: DataFrame) -> Column:
    """A row as one JSON object with all its keys, null ones too."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def _write_text(lines: DataFrame, path: str, one_file: bool) -> None:
    """A folder of part files, or one file: the parts, written by all tasks, are then appended in order by the driver, streaming."""
    if not one_file:
        lines.write.mode("overwrite").text(path)
        return
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    fs.delete(to, True)
    out = fs.create(to, True)
    try:
        for status in sorted(fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts)), key=lambda x: x.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                into = fs.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
                into.close()
    finally:
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def to_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder with a part for each task, or one file; an existing one is replaced."""
    _write_text(df.select(as_json(df).alias("value")), path, one_file)


def flattened(df: DataFrame) -> DataFrame:
    """``df`` with nested columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(*[F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def to_parquet(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").parquet(path)


def to_hub(df: DataFrame, repo: str) -> None:
    """Uploading needs a client library and a network, which this engine does without."""
    raise NotImplementedError(f"no upload client is installed for '{repo}'; write with to_jsonl and upload the files")


def with_splits(df: DataFrame, train=0.8, val=0.1, test=0.1, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``split``: exactly int(n * train), int(n * val) rows, the rest test, in the order of a seeded hash.

    Hash positions are counted in two steps: rows by the hash's first three digits, then within these, so that no task
    sorts everything.
    """
    if abs(train + val + test - 1.0) > 0.01:
        raise ValueError(f"splits sum to {train + val + test}, not 1")
    h = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))).withColumn("__b", F.substring("__h", 1, 3))
    sizes = h.groupBy(F.col("__b").alias("b")).agg(F.count("*").alias("n"))
    starts = sizes.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("n").over(Window.partitionBy()).alias("__n"))
    position = F.col("__start") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col))
    cut1, cut2 = F.floor(F.col("__n") * F.lit(float(train))), F.floor(F.col("__n") * F.lit(float(val)))
    placed = h.join(starts, F.col("__b") == F.col("b")).withColumn("__at", position)
    return placed.select(*df.columns, F.when(F.col("__at") <= cut1, "train").when(F.col("__at") <= cut1 + cut2, "validation").otherwise("test").alias("split"))


def export(samples: DataFrame, topic: str, out_dir: str, run_id: str = "", one_file: bool = True) -> int:
    """Writes the accepted samples' ``content`` to <topic>_dataset.jsonl and <topic>_metadata.json; nothing without samples.

    Both are files; ``one_file=False`` leaves the dataset as a folder of parts, for sizes that one file shouldn't have."""
    kept = samples.where("verdict IS NULL OR verdict <> 'reject'")
    n = kept.count()
    if n:
        spark = samples.sparkSession
        stem = spark.range(1).select(file_stem(F.lit(topic)).alias("s")).first()["s"]
        _write_text(kept.select(F.to_json("content").alias("value")), f"{out_dir}/{stem}_dataset.jsonl", one_file)
        about = {"topic": topic, "run_id": run_id, "total_samples": n, "exported_at": datetime.now(timezone.utc).isoformat()}
        _write_text(spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1), f"{out_dir}/{stem}_metadata.json", True)
    return n
