"""Best-fit packing of documents into sequences of fixed length, by bin completion branch-and-bound.

A text counts as one token for every started four characters. A document longer than ``capacity`` gives full pieces, each
a sequence of its own, and the rest as a piece; all pieces under the capacity are spread over shards of about
``shard_pieces`` by a hash, and each shard is packed on its own. Best-fit decreasing gives the incumbent. Where it needs
more sequences than the lower bound, bin completion searches on: around the largest piece left it enumerates fillings of
the space that remains, least waste first; a filling is dominated, and skipped, when one piece that is left out could take
the place of one or two in it without exceeding the space; a branch ends when its waste exceeds what a better packing may
waste in all. Where no filling is exact any more, best-fit decreasing completes the branch, and the result is the new incumbent
if it needs fewer sequences; then the search goes on below it. The search stops at the lower bound, or after ``steps`` enumeration
steps with the best packing so far, which is complete in any case: steps bound the search, never what is packed.

Rows of one id and one length are counted before anything moves, so that a hot id is one row; its copies are dealt to shards
in lots of at most ``shard_pieces``.

Defined results: null and empty texts have no tokens and aren't packed; a piece of exactly the capacity fills a sequence; very
long texts are cut into pieces without gaps; equal lengths are packed in the order of doc_id (null last) and start; repeated rows
are packed as often as they occur; extra columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import checkpointed

CAPACITY, SHARD_PIECES, STEPS, CHARS = 2048, 4096, 400_000, 4
#: Of the steps, how many one node may spend on each of exact and other fillings before the search goes on with those found.
NODE_STEPS = 2000


def lower_bound(lengths: list[int], capacity: int) -> int:
    """The larger of the bounds by volume and, for each cut k, by pieces over capacity - k, over half, and the volume that they leave."""
    x = np.sort(np.array(lengths, np.int64))
    volume = np.concatenate([[0], np.cumsum(x)])
    half = np.searchsorted(x, capacity // 2, "right")  # pieces from here on are over half
    k = np.unique(np.concatenate([[0], x[:half]]))
    big = np.searchsorted(x, capacity - k, "right")
    rest = volume[half] - volume[np.searchsorted(x, k, "left")]
    left = (big - half) * capacity - (volume[big] - volume[half])
    most = len(x) - half + np.maximum(0, -(-(rest - left) // capacity))
    return int(max(-(-volume[-1] // capacity), most.max()))


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions; ``lengths`` descends."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for k, x in enumerate(lengths):
        at = bisect_left(room, (x, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(k)
        else:
            left, b = capacity, len(bins)
            bins.append([k])
        insort(room, (left - x, b))
    return bins


class _Search:
    """Counts of pieces by length; fillings of a space in order of waste."""

    def __init__(self, lengths: list[int], capacity: int, steps: int):
        self.capacity, self.steps = capacity, steps
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sizes = sorted(self.count, reverse=True)
        self.least = self.sizes[-1] if self.sizes else 0

    def _fits(self, space: int, at: int) -> range:
        """Which of the sizes from ``at`` on are at most ``space``."""
        return range(max(at, bisect_left(self.sizes, -space, key=lambda x: -x)), len(self.sizes))

    def exact(self, space: int, at: int, taken: list[int], end: int) -> Iterator[tuple[int, ...]]:
        """Multisets of the pieces left that fill ``space`` exactly, large pieces first; until ``end`` steps are left."""
        for k in self._fits(space, at):
            x = self.sizes[k]
            if not self.count[x]:
                continue
            self.steps -= 1
            if self.steps <= end:
                return
            taken.append(x)
            if x == space:
                yield tuple(taken)
            elif space - x >= self.least:
                self.count[x] -= 1
                try:
                    yield from self.exact(space - x, k, taken, end)
                finally:
                    self.count[x] += 1
            taken.pop()

    def maximal(self, space: int, at: int, taken: list[int], end: int, out: list[tuple[int, tuple[int, ...]]]) -> None:
        """Adds (waste, filling) of the fillings that leave something and that no piece behind their last one could extend."""
        extended = False
        for k in self._fits(space, at):
            x = self.sizes[k]
            if not self.count[x]:
                continue
            self.steps -= 1
            if self.steps <= end:
                break
            extended = True
            self.count[x] -= 1
            taken.append(x)
            self.maximal(space - x, k, taken, end, out)
            taken.pop()
            self.count[x] += 1
        if not extended and space:
            out.append((space, tuple(taken)))

    def dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        """Whether a piece left out could be added, or take the place of a smaller one or of two; counts are without ``filling``."""
        self.steps -= len(filling) ** 2
        count = self.count
        near = lambda low, high: any(count[self.sizes[k]] for k in range(bisect_left(self.sizes, -high, key=lambda x: -x), bisect_left(self.sizes, -low + 1, key=lambda x: -x)))
        return any(near(x + 1, x + waste) for x in {0, *filling}) or any(near(x, x + waste) for x in {a + b for i, a in enumerate(filling) for b in filling[i + 1 :]})

    def fillings(self, space: int, allowed: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings and their waste, least waste first. Their pieces are out of the counts until the next is asked for."""
        if self.count.get(space, 0):  # one piece that fills the space dominates every other filling
            self.count[space] -= 1
            try:
                yield (space,), 0
            finally:
                self.count[space] += 1
            return
        for filling in self.exact(space, 0, [], self.steps - NODE_STEPS):
            # ``exact`` has all but the last piece out of the counts.
            self.count[filling[-1]] -= 1
            try:
                yield filling, 0
            finally:
                self.count[filling[-1]] += 1
        others: list[tuple[int, tuple[int, ...]]] = []
        self.maximal(space, 0, [], self.steps - NODE_STEPS, others)
        for waste, filling in sorted(set(others), key=lambda x: (x[0], [-y for y in x[1]])):
            if waste > allowed or self.steps <= 0:
                return
            for x in filling:
                self.count[x] -= 1
            try:
                if not self.dominated(filling, waste):
                    yield filling, waste
            finally:
                for x in filling:
                    self.count[x] += 1

    def largest(self) -> int:
        return next((x for x in self.sizes if self.count[x]), 0)


def bin_completion(lengths: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """The best packing found: bins of positions of ``lengths``, which descends and holds nothing over the capacity."""
    best = best_fit_decreasing(lengths, capacity)
    bound, total = lower_bound(lengths, capacity), sum(lengths)
    while len(best) > bound and steps > 0:
        search = _Search(lengths, capacity, steps)
        found = _better(search, len(best), total)
        if found is None:
            break
        steps = search.steps
        where: dict[int, list[int]] = {}
        for k in range(len(lengths) - 1, -1, -1):
            where.setdefault(lengths[k], []).append(k)
        best = [[where[x].pop() for x in bin_] for bin_ in found]
    return best


def _better(search: _Search, bins: int, total: int) -> list[tuple[int, ...]] | None:
    """A packing into less than ``bins`` bins of lengths, None if there is none or the steps are over."""
    capacity = search.capacity
    allowed = (bins - 1) * capacity - total
    path: list[tuple[int, ...]] = []
    stack: list[tuple[Iterator, int]] = []
    wasted = 0
    a = search.largest()
    search.count[a] -= 1
    stack.append((search.fillings(capacity - a, allowed), a))
    while stack and search.steps > 0:
        options, a = stack[-1]
        if len(path) == len(stack):
            wasted -= capacity - a - sum(path.pop())
        nxt = next(options, None)
        if nxt is None or wasted + nxt[1] > allowed:  # later fillings waste no less
            options.close()
            search.count[a] += 1
            stack.pop()
            continue
        path.append(nxt[0])
        wasted += nxt[1]
        b = search.largest()
        if not b:
            return [(x, *f) for (_, x), f in zip(stack, path)]
        if nxt[1]:
            left = [x for x in search.sizes for _ in range(search.count[x])]
            search.steps -= len(left)
            rest = best_fit_decreasing(left, capacity)
            if len(path) + len(rest) < bins:
                return [(x, *f) for (_, x), f in zip(stack, path)] + [tuple(left[k] for k in bin_) for bin_ in rest]
        search.count[b] -= 1
        stack.append((search.fillings(capacity - b, allowed - wasted), b))
    return None


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, chars, copies, tokens) of the texts that aren't empty, one row for each id and length, checkpointed: the texts are read once."""
    sized = docs.select("doc_id", F.length("text").alias("chars")).where("chars > 0").groupBy("doc_id", "chars").agg(F.count("*").alias("copies"))
    return checkpointed(sized.withColumn("tokens", F.expr(f"cast((chars + {CHARS - 1}) div {CHARS} as int)")))


def _lots(counted: DataFrame, size: int) -> DataFrame:
    """Rows with at most ``size`` copies each, numbered by ``lot``."""
    return counted.withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {size})"))).withColumn("copies", F.least(F.lit(size), F.col("copies") - F.col("lot") * size).cast("int"))


SCHEMA = "shard long, bin long, pieces array<struct<doc_id: long, start: long, chars: long, tokens: int>>, tokens int, waste int"


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, steps: int = STEPS) -> DataFrame:
    """(shard, bin, pieces, tokens, waste): one row for each sequence; a piece is a span of characters of a document.

    Sequences that one piece fills have shard -1 and the piece's number within its document as bin.
    """
    all_pieces = pieces(docs, capacity)
    # Copies of long texts are dealt out before they are repeated.
    long = _lots(all_pieces.where(f"tokens >= {capacity}"), shard_pieces).repartition("doc_id", "chars", "lot").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    full = long.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"tokens div {capacity} - 1"))))
    span = F.struct("doc_id", (F.col("bin") * capacity * CHARS).alias("start"), F.least(F.lit(capacity * CHARS), F.col("chars") - F.col("bin") * capacity * CHARS).cast("long").alias("chars"), F.lit(capacity).alias("tokens"))
    whole = full.select(F.lit(-1).cast("long").alias("shard"), "bin", F.array(span).alias("pieces"), F.lit(capacity).alias("tokens"), F.lit(0).alias("waste"))
    rest = all_pieces.where(f"tokens % {capacity} > 0").select("doc_id", F.expr(f"tokens div {capacity} * {capacity * CHARS}").cast("long").alias("start"), "chars", F.expr(f"tokens % {capacity}").alias("tokens"), "copies").withColumn("chars", (F.col("chars") - F.col("start")).cast("long"))
    shards = max(1, -(-(rest.agg(F.sum("copies")).first()[0] or 0) // shard_pieces))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.loc[f.index.repeat(f["copies"])]
        f = f.assign(id=[np.iinfo(np.int64).max if x is None else int(x) for x in f["doc_id"]], none=f["doc_id"].isna())
        f = f.sort_values(["tokens", "none", "id", "start"], ascending=[False, True, True, True], kind="stable")
        ids = [None if x is None else int(x) for x in f["doc_id"]]
        starts, chars, tokens = f["start"].tolist(), f["chars"].tolist(), f["tokens"].tolist()
        bins = bin_completion(tokens, capacity, steps)
        out = [[{"doc_id": ids[k], "start": starts[k], "chars": chars[k], "tokens": tokens[k]} for k in b] for b in bins]
        sums = np.array([sum(tokens[k] for k in b) for b in bins], np.int32)
        return pd.DataFrame({"shard": int(f["shard"].iloc[0]), "bin": np.arange(len(bins)), "pieces": out, "tokens": sums, "waste": capacity - sums})

    dealt = _lots(rest, shard_pieces).withColumn("shard", F.pmod(F.xxhash64("doc_id", "chars", "start", "lot"), F.lit(shards)))
    packed = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard").applyInPandas(solve, SCHEMA)
    return whole.unionByName(packed)
