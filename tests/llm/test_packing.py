import random
from itertools import combinations

import pytest

from quernstone.llm import packing as P
from quernstone.llm._common import ship


def optimum(lengths, capacity):
    """The least number of bins by trying all."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in {x: i for i, x in enumerate(bins) if x + lengths[k] <= capacity}.values():
            bins[b] += lengths[k]
            place(k + 1, bins)
            bins[b] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_small_cases_are_optimal(seed):
    rnd = random.Random(seed)
    lengths = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(1, 9))), reverse=True)
    bins = P.bin_completion(lengths, 60)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 60 for b in bins)
    assert len(bins) == optimum(lengths, 60) >= P.lower_bound(lengths, 60)


def test_beats_best_fit_decreasing():
    """Found by search: best-fit decreasing needs a bin more than the optimum."""
    rnd = random.Random(0)
    better = 0
    for _ in range(300):
        lengths = sorted((rnd.randint(10, 50) for _ in range(12)), reverse=True)
        a, b = len(P.best_fit_decreasing(lengths, 100)), len(P.bin_completion(lengths, 100))
        assert b <= a
        better += b < a
    assert better > 0


def test_dominated_fillings_are_left_out():
    s = P._Search([50, 30, 20, 15, 10], 100, 10_000)
    s.count[50] -= 1
    found = [f for f, _ in s.fillings(50, 50)]
    assert found[0] == (30, 20)
    for f in found:
        left = sorted({30, 20, 15, 10} - set(f))
        waste = 50 - sum(f)
        assert not any(x <= waste for x in left)
        assert not any(0 < x - y <= waste for x in left for y in f)
        assert not any(0 <= x - y - z <= waste for x in left for y, z in combinations(f, 2))


def test_whole_texts_are_packed_once(spark):
    ship(spark)
    rnd = random.Random(2)
    rows = [(k, "x" * rnd.choice([0, 1, 3, 100, 2048 * 4, 2048 * 4 + 1, 30_000, 5000])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.pack(docs, shard_pieces=64).collect()
    spans = sorted((p["doc_id"], p["start"], p["chars"]) for r in found for p in r["pieces"])
    want = {}
    for i, start, chars in spans:
        assert start == want.get(i, 0)
        want[i] = start + chars
    assert want == {k: len(t) for k, t in rows if t}
    assert all(r["tokens"] + r["waste"] == P.CAPACITY and r["tokens"] == sum(p["tokens"] for p in r["pieces"]) for r in found)
    assert all(p["tokens"] == -(-p["chars"] // P.CHARS) for r in found for p in r["pieces"])


def test_the_search_saves_sequences_at_the_shipped_settings(spark):
    """Full shards of lengths for which best-fit decreasing isn't optimal."""
    ship(spark)
    rnd = random.Random(8)
    tokens = [rnd.randint(200, 1100) for _ in range(P.SHARD_PIECES)]
    greedy, bound = len(P.best_fit_decreasing(sorted(tokens, reverse=True), P.CAPACITY)), P.lower_bound(tokens, P.CAPACITY)
    docs = spark.createDataFrame([(k, "x" * (4 * n)) for k, n in enumerate(tokens)], "doc_id long, text string")
    found = P.pack(docs).collect()
    assert bound <= len(found) <= greedy - 5
    assert sorted((p["doc_id"], p["tokens"]) for r in found for p in r["pieces"]) == list(enumerate(tokens))


def slow_bound(lengths, capacity):
    best = -(-sum(lengths) // capacity)
    for k in {x for x in lengths if 2 * x <= capacity} | {0}:
        big, half = [x for x in lengths if x > capacity - k], [x for x in lengths if capacity - k >= x and 2 * x > capacity]
        rest = sum(x for x in lengths if 2 * x <= capacity and x >= k)
        best = max(best, len(big) + len(half) + max(0, -(-(rest - (len(half) * capacity - sum(half))) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(20))
def test_lower_bound_matches_its_definition(seed):
    rnd = random.Random(seed)
    for capacity in (20, 101, 2048):
        lengths = [rnd.randint(1, capacity - 1) for _ in range(rnd.randint(1, 400))]
        assert P.lower_bound(lengths, capacity) == slow_bound(lengths, capacity)


def test_repeated_rows_are_dealt_to_many_shards(spark):
    """A third of all rows with a null id and one length, and one row that repeats: no shard gets them all."""
    ship(spark)
    rows = [(None, "x" * 900)] * 1000 + [(7, "y" * 20_000)] * 500 + [(k, "z" * (40 + k)) for k in range(1500)]
    found = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_pieces=100).collect()
    sizes = {}
    for r in found:
        if r["shard"] >= 0:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["pieces"])
    assert max(sizes.values()) <= 500
    got = sorted(((p["doc_id"] is None, p["doc_id"], p["chars"]) for r in found for p in r["pieces"]), key=str)
    spans = lambda n: [min(8192, n - a) for a in range(0, n, 8192)]
    assert got == sorted(((i is None, i, c) for i, t in rows for c in spans(len(t))), key=str)


def test_ties_go_by_id(spark):
    ship(spark)
    docs = spark.createDataFrame([(k, "x" * 2000) for k in (3, 1, 2, None)], "doc_id long, text string")
    a, b = (sorted(map(str, P.pack(docs.repartition(n)).collect())) for n in (1, 3))
    assert a == b
