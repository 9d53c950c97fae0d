"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has five segments of 23 bits: the signs of the sum, over a text's distinct words, of +1/-1 for each bit of
the word's hash. The binary Golay code [23, 12, 7] is perfect: each segment lies within 3 bits of exactly one codeword.
A segment's keys are the 12-bit indices of all codewords within 4 bits of it: one where the nearest is at most 2 bits
away, else six. Two segments that differ in at most 2 bits have a point within 1 bit of both, whose codeword is within 4
bits of both, so they share a key. A row key joins the keys of two segments. By the pigeonhole principle, of two
fingerprints at most ``EXACT`` = 11 bits apart at most three segments have 3 or more errors, so two are within 2 bits and
the pair shares a row key: no such pair is missed. Pairs of 12 to ``THRESHOLD`` bits are found when their errors leave
two segments that share a key, which is likely but not certain; ``tests/llm`` measures recall against brute force.

Long texts of one language share most of their words, so words alone would join strangers. A second fingerprint of 64 bits,
of the distinct word triples, verifies: near-duplicates are at most ``THRESHOLD`` bits apart in the first and at most
``TRIPLES`` bits in the second.

The row that is shuffled is three longs: table, the two codeword indices, how the two segments differ from these codewords,
the other three segments, and the triples' bits. It holds the key and all that verifies, so candidates are verified where
they meet, with neither texts nor a second join. Every bucket is done in full: rows are compared in blocks, and where a block has many
near-duplicates, a connected component is found by sweeps from one member over all that aren't reached yet, so that a bucket of
thousands of copies costs few sweeps and links in proportion to its rows.

Scale: a key has 24 bits in each of ten tables, so a bucket holds strangers where distinct fingerprints are far more than 2^24
times a few: with N of them some 28 N / 2^24 in a bucket, and the time of a bucket grows with its square. README gives figures.

Defined results: a null text is in no group; texts without a word (empty, punctuation) are grouped when equal; very long texts are
hashed whole; rows that repeat (same id, same text) are copies and one stays, of rows that differ in other columns the one of least hash;
the row that stays in a group is the one with the least doc_id (null last), then the least text hash; extra columns pass through
untouched, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm._common import checkpointed, text_groups

SEGMENTS, WIDTH, BITS, EXACT = 5, 23, 115, 11
#: Bits by which the fingerprints of near-duplicates may differ, of words and of word triples.
THRESHOLD, TRIPLES = 19, 21
TABLES = list(combinations(range(SEGMENTS), 2))
_GENERATOR = 0xAE3
_WORD = re.compile(r"\w+")
_SMALL, _BLOCK = 8, 32
#: Rows to drop that are broadcast at most, 16 bytes each; beyond, they are joined by shuffling.
MAX_BROADCAST = 2_000_000


def _remainder(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64).copy()
    for k in range(22, 10, -1):
        r ^= np.where((r >> k) & 1, _GENERATOR << (k - 11), 0)
    return r


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codewords by index, error patterns [2048, 6] by syndrome, how many of the six there are)."""
    index = np.arange(4096, dtype=np.int64) << 11
    codewords = index | _remainder(index)
    patterns, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), weight)], np.int64)
        for w, s in zip(words.tolist(), _remainder(words).tolist()):
            if weight < 4 or count[s]:
                patterns[s, count[s]] = w
                count[s] += 1
    return codewords, patterns, count


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    return _remainder(np.arange(1 << WIDTH, dtype=np.int64)).astype(np.uint16)


def _bit_counts(raw: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """[n, bits] how many of each owner's rows of bytes have each bit; ``owner`` rises. Works in slices: a text may be very long."""
    out = np.zeros((n, bits), np.int64)
    for at in range(0, len(owner), 65_536):
        o = owner[at : at + 65_536]
        starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        out[o[starts]] += np.add.reduceat(np.unpackbits(raw[at : at + 65_536], axis=1)[:, :bits], starts, axis=0, dtype=np.int64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def fingerprints_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """([n, 5] segments, [n] bits of word triples as int64); segments are -1 where a text is null or has no word."""
    out, triples = np.full((len(texts), SEGMENTS), -1, np.int64), np.zeros(len(texts), np.int64)
    powers = 1 << np.arange(WIDTH, dtype=np.int64)
    for a, b in text_groups(texts, 400_000):
        number: dict[str, int] = {}
        found = [_WORD.findall(t.lower()) if t else () for t in texts[a:b]]
        sizes = np.array([len(f) for f in found])
        word = np.fromiter((number.setdefault(w, len(number)) for f in found for w in f), np.int64, int(sizes.sum()))
        if not len(word):
            continue
        table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint8).reshape(-1, 16)
        doc = np.repeat(np.arange(b - a), sizes)
        distinct = np.unique(doc * len(number) + word)
        owner = distinct // len(number)
        ones = _bit_counts(table[distinct % len(number), :15], owner, b - a, BITS)
        full = np.flatnonzero(sizes)
        sign = (2 * ones > np.bincount(owner, minlength=b - a)[:, None])[full].reshape(-1, SEGMENTS, WIDTH)
        out[a + full] = sign @ powers
        h = np.ascontiguousarray(table[:, 8:]).view(np.uint64).ravel()[word]
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        three = h[whole] * np.uint64(0x9E3779B97F4A7C15) + h[whole + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[whole + 2] * np.uint64(0x165667B19E3779F9)
        few = np.flatnonzero(sizes[doc] < 3)  # shorter texts go by their words
        g, owner = _mixed(np.concatenate([three, h[few]])), np.concatenate([doc[whole], doc[few]])
        order = np.lexsort((g, owner))
        g, owner = g[order], owner[order]
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])])
        g, owner = g[first], owner[first]
        ones = _bit_counts(g.view(np.uint8).reshape(-1, 8), owner, b - a, 64)
        triples[a:b] = np.packbits(2 * ones > np.bincount(owner, minlength=b - a)[:, None], axis=1).view(np.int64).ravel()
    return out, triples


def node_numbers(hi: np.ndarray, lo: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """One number for each fingerprint, by which it is joined."""
    x = _mixed(_mixed(_mixed(hi.view(np.uint64)) + lo.view(np.uint64)) + triples.view(np.uint64))
    return x.view(np.int64)


def pack(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as two int64: hi has segments 0, 1 and the top of 2, lo the rest."""
    s = segments.astype(np.int64)
    return s[:, 0] << 31 | s[:, 1] << 8 | s[:, 2] >> 15, (s[:, 2] & 0x7FFF) << 46 | s[:, 3] << 23 | s[:, 4]


def unpack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    m = (1 << WIDTH) - 1
    return np.stack([hi >> 31 & m, hi >> 8 & m, (hi & 0xFF) << 15 | lo >> 46 & 0x7FFF, lo >> 23 & m, lo & m], axis=1)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("hi", "lo", "triples", "n")]))
def _fingerprint(text: pd.Series) -> pd.DataFrame:
    segments, triples = fingerprints_of([t if isinstance(t, str) else None for t in text])
    hi, lo = pack(np.maximum(segments, 0))
    none = segments[:, 0] < 0
    columns = {"hi": hi, "lo": lo, "triples": triples, "n": node_numbers(hi, lo, triples)}
    return pd.DataFrame({k: pd.arrays.IntegerArray(x, none.copy()) for k, x in columns.items()})


def row_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shuffled rows of fingerprints: (a, b, which fingerprint), the key in the upper 28 bits of a."""
    _, patterns, count = golay()
    syndrome = _syndromes()[segments].astype(np.int64)
    each: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(segments)
    many = [count[syndrome[:, k]] for k in range(SEGMENTS)]
    for t, (i, j) in enumerate(TABLES):
        pairs = many[i] * many[j]
        row = np.repeat(np.arange(n), pairs)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        ki, kj = nth // many[j][row], nth % many[j][row]
        si, sj = syndrome[row, i], syndrome[row, j]
        ci, cj = (segments[row, i] ^ patterns[si, ki]) >> 11, (segments[row, j] ^ patterns[sj, kj]) >> 11
        p, q, r = (segments[row, k] for k in range(SEGMENTS) if k not in (i, j))
        top = (t if t < 8 else t - 16) << 60
        a = top | ci << 48 | cj << 36 | (si << 3 | ki) << 22 | (sj << 3 | kj) << 8 | p >> 15
        each.append((a, (p & 0x7FFF) << 46 | q << 23 | r, row))
    a, b, row = (np.concatenate([x[k] for x in each]) for k in range(3))
    return a, b, row


def row_fingerprints(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the rows that ``row_keys`` made."""
    codewords, patterns, _ = golay()
    t = a >> 60 & 15
    di, dj = a >> 22 & 0x3FFF, a >> 8 & 0x3FFF
    si = codewords[a >> 48 & 0xFFF] ^ patterns[di >> 3, di & 7]
    sj = codewords[a >> 36 & 0xFFF] ^ patterns[dj >> 3, dj & 7]
    rest = [(a & 0xFF) << 15 | b >> 46 & 0x7FFF, b >> 23 & 0x7FFFFF, b & 0x7FFFFF]
    out = np.empty((len(a), SEGMENTS), np.int64)
    for k, (i, j) in enumerate(TABLES):
        at = t == k
        if at.any():
            out[at, i], out[at, j] = si[at], sj[at]
            for c, x in zip((c for c in range(SEGMENTS) if c not in (i, j)), rest):
                out[at, c] = x[at]
    return pack(out)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo, triples = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        for at in range(0, len(hi), 500):
            a, b, row = row_keys(unpack(hi[at : at + 500], lo[at : at + 500]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(triples[at + row])], ["a", "b", "c"])


class Prints:
    """Fingerprints side by side, and which of them are near-duplicates."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, triples: np.ndarray, threshold: int = THRESHOLD, limit: int = TRIPLES):
        # Bits are counted without a sign: numpy counts those of the absolute value.
        self.hi, self.lo, self.triples, self.threshold, self.limit = hi, lo, triples.astype(np.uint64), threshold, limit

    def near(self, u: np.ndarray, v) -> np.ndarray:
        d = np.bitwise_count(self.hi[u] ^ self.hi[v]).astype(np.int16) + np.bitwise_count(self.lo[u] ^ self.lo[v])
        return (d <= self.threshold) & (np.bitwise_count(self.triples[u] ^ self.triples[v]) <= self.limit)


def bucket_links(key: np.ndarray, prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """Positions (u, v) of links that connect, in each run of equal keys, what verified pairs connect."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    starts, sizes = cuts[:-1], np.diff(cuts)
    for size in range(2, _SMALL + 1):
        at = starts[sizes == size]
        for x, y in combinations(range(size), 2) if len(at) else ():
            ok = prints.near(at + x, at + y)
            us.append((at + x)[ok])
            vs.append((at + y)[ok])
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        left, bits = np.arange(start, start + size), prints.triples[start : start + size]
        while len(left) > 1:
            # Of strangers some 1 in 250 is this near in its triples; only these are compared in full.
            block = min(_BLOCK, len(left))
            i, j = np.nonzero(np.bitwise_count(bits[:block, None] ^ bits[None, :]) <= prints.limit)
            i, j = i[j > i], j[j > i]
            ok = prints.near(left[i], left[j])
            i, j = i[ok], j[ok]
            if len(i) <= 8 * block:  # few: every pair is a link
                us.append(left[i])
                vs.append(left[j])
                left, bits = left[block:], bits[block:]
                continue
            # Many: one component is swept from its first member, a link for each of the others.
            root = int(i[0])
            queue, first = [int(left[root])], int(left[root])
            rest = np.ones(len(left), bool)
            rest[root] = False
            left, bits = left[rest], bits[rest]
            while queue and len(left):
                one = queue.pop()
                maybe = np.flatnonzero(np.bitwise_count(bits ^ prints.triples[one]) <= prints.limit)
                maybe = maybe[prints.near(left[maybe], one)] if len(maybe) else maybe
                if len(maybe):
                    found, rest = left[maybe], np.ones(len(left), bool)
                    rest[maybe] = False
                    left, bits = left[rest], bits[rest]
                    us.append(np.full(len(found), first))
                    vs.append(found)
                    queue.extend(found.tolist())
    return np.concatenate(us), np.concatenate(vs)


def _bucket_task(threshold: int, limit: int):
    def close(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Links [2, n] between the numbers of the rows' fingerprints."""
        key = a >> 36
        same = np.zeros(len(a), bool)
        eq = key[1:] == key[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        if not same.any():
            return np.zeros((2, 0), np.int64)
        hi, lo = row_fingerprints(a[same], b[same])
        u, v = bucket_links(key[same], Prints(hi, lo, c[same], threshold, limit))
        ends = np.stack([node_numbers(hi[x], lo[x], c[same][x]) for x in (u, v)])
        return np.stack([ends.max(0), ends.min(0)])

    def out(links: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(links, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[np.ndarray] = []
        parts: list[list[np.ndarray]] = [[], [], []]
        rows = 0
        for batch in batches:
            for k in range(3):
                parts[k].append(batch.column(k).to_numpy())
            rows += batch.num_rows
            if rows < 200_000:
                continue
            a, b, c = map(np.concatenate, parts)
            last = int(np.searchsorted(a >> 36, a[-1] >> 36, "left"))
            wait.append(close(a[:last], b[:last], c[:last]))
            parts, rows = [[a[last:]], [b[last:]], [c[last:]]], len(a) - last
            if sum(x.shape[1] for x in wait) > 500_000:
                yield out(wait)
                wait = []
        if rows:
            wait.append(close(*map(np.concatenate, parts)))
        if wait:
            yield out(wait)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long), root the least of its component: large star and small star in turn.

    Each round is checkpointed. Rounds end when a round changes nothing.
    """
    edges = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = now


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, hi, lo, triples): th is a hash of the text, n the number of its fingerprint (th without words); rows with a null text are left out."""
    return docs.select("doc_id", "text").where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), _fingerprint("text").alias("f")).select("doc_id", "th", F.coalesce("f.n", "th").alias("n"), "f.hi", "f.lo", "f.triples")


def link_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD, limit: int = TRIPLES) -> DataFrame:
    """(u, v): verified links between the numbers of the fingerprints (hi, lo, triples), which are distinct."""
    keys = distinct.select("hi", "lo", "triples").mapInArrow(_explode, "a long, b long, c long")
    met = keys.repartition(F.shiftright("a", 36)).sortWithinPartitions("a")
    return met.mapInArrow(_bucket_task(threshold, limit), "u long, v long").distinct()


def groups(docs: DataFrame, threshold: int = THRESHOLD, limit: int = TRIPLES) -> DataFrame:
    """(doc_id, th, keep_id, keep_th, copies): every row identity (doc_id, th), the identity that its group keeps, and how
    many rows have this identity."""
    prints = checkpointed(fingerprints(docs).groupBy("doc_id", "th").agg(*[F.first(x).alias(x) for x in ("n", "hi", "lo", "triples")], F.count("*").alias("copies")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    nodes = checkpointed(prints.groupBy("n").agg(*[F.first(x).alias(x) for x in ("hi", "lo", "triples")], least))
    roots = components(link_fingerprints(nodes.where("hi IS NOT NULL"), threshold, limit))
    placed = nodes.select("n", "least").join(roots, nodes.n == roots.node, "left").select("n", "least", "root")
    # Nodes without links keep their own least row; only linked ones are grouped again.
    linked = placed.where("root IS NOT NULL")
    kept = linked.join(linked.groupBy("root").agg(F.min("least").alias("keep")), "root").select("n", "keep").unionByName(placed.where("root IS NULL").select("n", F.col("least").alias("keep")))
    return prints.select("doc_id", "th", "copies", "n").join(kept, "n").select("doc_id", "th", F.col("keep.doc_id").alias("keep_id"), F.col("keep.th").alias("keep_th"), "copies")


def _same():
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, limit: int = TRIPLES) -> DataFrame:
    """(doc_id, duplicate_of, copies): the rows that have to go. ``copies`` counts the rows that go with this id.

    A repeated row (same id and text) of a kept document is listed with duplicate_of = doc_id.
    """
    found = groups(docs, threshold, limit)
    return found.select("doc_id", F.col("keep_id").alias("duplicate_of"), (F.col("copies") - _same().cast("int")).alias("copies")).where("copies > 0")


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, limit: int = TRIPLES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with one row of each group; rows with a null text stay.

    Up to ``max_broadcast`` rows to drop are broadcast (id and text hash) and texts stay where they are; beyond, documents are
    shuffled by id and text hash, which no key can make hot but a repeated row, whose copies are combined before.
    """
    found = groups(docs, threshold, limit).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), _same().alias("__same"), "copies")
    drop = checkpointed(found.where("NOT __same OR copies > 1"))
    repeated = drop.where("__same").select("__id", "__th")
    small = drop.count() <= max_broadcast

    def keyed(how: str, keys: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keys["__id"]) & (F.xxhash64(docs["text"]) == keys["__th"]), how)

    rest = keyed("left_anti", drop.select("__id", "__th"))
    if repeated.isEmpty():
        return rest
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    number = "__th" + "_" * max(map(len, docs.columns))
    # The least row by a hash of all its columns; partial aggregates leave one row of each task.
    once = keyed("left_semi", repeated).groupBy("doc_id", F.xxhash64("text").alias(number)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return rest.unionByName(once)
