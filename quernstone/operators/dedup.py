"""Exact and near-duplicates: MD5, 64-bit SimHash, exact search by Hamming distance, and the greedy rule in a given order.

The greedy rule: documents come in the order of a column; one that equals a registered document is an exact duplicate of it,
one within ``distance`` bits of a registered fingerprint is a near-duplicate of the first such document, any other is
registered. Duplicates aren't registered, so a document near only to a dropped one stays.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quernstone.functions.text import one_by_one
from quernstone.sources.shared import checkpointed

DISTANCE, BITS = 3, 64
_TOKEN = re.compile(r"\w+")


@lru_cache(maxsize=200_000)
def _token_bits(token: str) -> bytes:
    return hashlib.md5(token.encode()).digest()[:8]


def fingerprint(text: str | None) -> int | None:
    """SimHash as a signed 64-bit number: a bit is set where more token occurrences have it than not; 0 without tokens."""
    if text is None:
        return None
    counts = Counter(_TOKEN.findall(text.lower()))
    if not counts:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(map(_token_bits, counts)), np.uint8).reshape(-1, 8), axis=1)
    n = np.fromiter(counts.values(), np.int64, len(counts))
    return int(np.packbits(2 * (n @ bits) > n.sum()).view(">i8")[0])


@F.arrow_udf(LongType())
def simhash(text: pa.Array) -> pa.Array:
    """Within a task, without a shuffle: exploding tokens and grouping them again would move every document."""
    return one_by_one(text, fingerprint, pa.int64())


def unsigned(fp: Column) -> Column:
    """A signed 64-bit number's bits as an unsigned decimal string."""
    return F.conv(F.hex(fp), 16, 10)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def are_near(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    return hamming(a, b) <= distance


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / BITS


def _masks(distance: int, extra: int) -> list[int]:
    """Masks of ``extra`` blocks out of distance + extra: two fingerprints within the distance agree on at least one of them."""
    edges = [round(k * BITS / (distance + extra)) for k in range(distance + extra + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(fps: DataFrame, distance: int, extra: int) -> DataFrame:
    keys = [F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(_masks(distance, extra))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def near_fingerprints(left: DataFrame, right: DataFrame | None = None, distance: int = DISTANCE, extra: int = 3) -> DataFrame:
    """(fp, other): pairs of the distinct fingerprints ``fp`` within ``distance``; within one table each pair once, fp < other.

    Exact by the pigeonhole principle; keys of ``extra`` blocks keep buckets small however many fingerprints there are.
    The keys are shuffled by hint: Spark takes an exploded table to be as small as what it came from, and would broadcast it.
    """
    a = _keyed(left.select("fp").distinct(), distance, extra)
    b = (a if right is None else _keyed(right.select("fp").distinct(), distance, extra)).withColumnRenamed("fp", "other")
    near = are_near(F.col("fp"), F.col("other"), distance)
    return a.hint("merge").join(b.hint("merge"), "key").where(near & (F.col("fp") < F.col("other")) if right is None else near).select("fp", "other").distinct()


def exact_duplicates(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(doc_id, duplicate_of): rows whose text occurs earlier in the order. The first of each text is found by partial aggregates, so
    copies are never sorted together."""
    digests = docs.select(order, F.md5("text").alias("digest")).where("digest IS NOT NULL")
    first = digests.groupBy("digest").agg(F.min(order).alias("duplicate_of"), F.count("*").alias("n")).where("n > 1").select("digest", "duplicate_of")
    return digests.join(first, "digest").where(F.col(order) > F.col("duplicate_of")).select(order, "duplicate_of")


def is_registered(probes: DataFrame, registered: DataFrame) -> DataFrame:
    """The rows of ``probes`` whose text is a text of ``registered``."""
    return probes.join(registered.select(F.md5("text").alias("__digest")).distinct(), F.md5(probes["text"]) == F.col("__digest"), "left_semi")


def classes(docs: DataFrame, order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of the documents with a text, and (fp, class_id, copies): documents of equal fingerprints are a class, named by its
    first. Both are checkpointed, so fingerprints are taken once."""
    own = checkpointed(docs.select(order, simhash("text").alias("fp")).where("fp IS NOT NULL"))
    return own, checkpointed(own.groupBy("fp").agg(F.min(order).alias("class_id"), F.count("*").alias("copies")))


def near_matches(probes: DataFrame, registered: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id") -> DataFrame:
    """(probe, class_id, copies, distance): every class of registered documents within the distance of each probe."""
    p = checkpointed(probes.select(F.col(id_col).alias("probe"), simhash("text").alias("fp")).where("fp IS NOT NULL"))
    known = classes(registered, id_col)[1].withColumnRenamed("fp", "other")
    pairs = near_fingerprints(p, known.select(F.col("other").alias("fp")), distance)
    return p.join(pairs, "fp").join(known, "other").select("probe", "class_id", "copies", hamming(F.col("fp"), F.col("other")).alias("distance"))


def near_pairs(docs: DataFrame, distance: int = DISTANCE, order: str = "doc_id") -> DataFrame:
    """(a, b, distance, copies_a, copies_b): pairs of classes within the distance, a before b; ``near_classes`` has who is in a class."""
    return _class_pairs(classes(docs, order)[1], distance)


def _class_pairs(found: DataFrame, distance: int) -> DataFrame:
    pairs = near_fingerprints(found, distance=distance)
    x = found.select("fp", F.struct("class_id", "copies").alias("x"))
    y = found.select(F.col("fp").alias("other"), F.struct("class_id", "copies").alias("y"))
    both = pairs.join(x, "fp").join(y, "other").select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g"), hamming(F.col("fp"), F.col("other")).alias("distance"))
    return both.select(F.col("l.class_id").alias("a"), F.col("g.class_id").alias("b"), "distance", F.col("l.copies").alias("copies_a"), F.col("g.copies").alias("copies_b"))


def near_classes(docs: DataFrame, distance: int = DISTANCE, order: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, copies, links): each document's class, its size, and how many other classes are within the distance."""
    own, found = classes(docs, order)
    pairs = _class_pairs(found, distance)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return own.join(found, "fp").join(links, "class_id", "left").select(order, "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _settle(edges: DataFrame) -> DataFrame:
    """(node): the nodes that the greedy rule drops; ``edges`` are (e, l), the earlier node first.

    A node without an earlier neighbour that is open or kept is kept, its later neighbours are dropped; rounds go on with
    the edges between open nodes until none is left. Each round is checkpointed.
    """
    dropped = edges.select(F.col("l").alias("node")).limit(0)
    while not edges.isEmpty():
        later = edges.select(F.col("l").alias("e")).distinct()
        kept = edges.select("e").distinct().join(later, "e", "left_anti")
        now = checkpointed(edges.join(kept, "e", "left_semi").select(F.col("l").alias("node")).distinct())
        dropped = dropped.unionByName(now)
        edges = checkpointed(edges.join(kept, "e", "left_anti").join(now, F.col("e") == F.col("node"), "left_anti").join(now, F.col("l") == F.col("node"), "left_anti"))
    return dropped


def greedy(docs: DataFrame, distance: int = DISTANCE, order: str = "doc_id") -> DataFrame:
    """(doc_id, is_duplicate, strategy, duplicate_of, similarity) for every document with a text."""
    prints = checkpointed(docs.select(order, F.md5("text").alias("digest"), simhash("text").alias("fp")).where("digest IS NOT NULL"))
    texts = prints.groupBy("digest", "fp").agg(F.min(order).alias("first"))
    # All later texts with an equal fingerprint go where the first of them goes.
    nodes = checkpointed(texts.groupBy("fp").agg(F.min("first").alias("node")))
    pairs = near_fingerprints(nodes, distance=distance)
    x, y = nodes.select("fp", F.col("node").alias("x")), nodes.select(F.col("fp").alias("other"), F.col("node").alias("y"))
    edges = checkpointed(pairs.join(x, "fp").join(y, "other").select(F.least("x", "y").alias("e"), F.greatest("x", "y").alias("l")))
    dropped = _settle(edges)
    kept_edges = edges.join(dropped.withColumnRenamed("node", "e"), "e", "left_anti")
    targets = kept_edges.groupBy(F.col("l").alias("node")).agg(F.min("e").alias("target"))
    placed = nodes.join(targets, "node", "left").select("fp", "node", F.coalesce("target", "node").alias("target"))
    of_target = placed.where("node = target").select("target", F.col("fp").alias("target_fp"))
    full = prints.join(texts, ["digest", "fp"]).join(placed, "fp").join(of_target, "target")
    strategy = F.when(F.col(order) == F.col("target"), F.lit(None)).when(F.col("first") == F.col("target"), "exact").otherwise("simhash")
    out = full.select(order, strategy.cast("string").alias("strategy"), "target", similarity(F.col("fp"), F.col("target_fp")).alias("s"))
    hit = F.col("strategy").isNotNull()
    return out.select(order, hit.alias("is_duplicate"), "strategy", F.when(hit, F.col("target")).alias("duplicate_of"), F.when(hit, F.col("s")).alias("similarity"))


def report(decided: DataFrame) -> DataFrame:
    """(total, exact_duplicates, near_duplicates, unique)."""
    n = lambda c: F.count_if(c)
    return decided.agg(
        F.count("*").alias("total"), n(F.coalesce(F.col("strategy") == "exact", F.lit(False))).alias("exact_duplicates"),
        n(F.coalesce(F.col("strategy") == "simhash", F.lit(False))).alias("near_duplicates"), n(~F.col("is_duplicate")).alias("unique"),
    )


def pairs(decided: DataFrame, order: str = "doc_id") -> DataFrame:
    """(doc_id, duplicate_of, similarity) of the duplicates."""
    return decided.where("is_duplicate").select(order, "duplicate_of", "similarity")


def keep(docs: DataFrame, distance: int = DISTANCE, order: str = "doc_id") -> DataFrame:
    """``docs`` without the duplicates of the greedy rule; rows with a null text stay."""
    gone = greedy(docs, distance, order).where("is_duplicate").select(F.col(order).alias("__gone"))
    return docs.join(gone, docs[order] == F.col("__gone"), "left_anti")
