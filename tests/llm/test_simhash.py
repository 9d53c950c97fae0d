import random

import numpy as np
import pytest

from quernstone.llm import simhash as S
from quernstone.llm._common import ship
from tests.conftest import SF


def test_golay_code_is_perfect():
    codewords, patterns, count = S.golay()
    assert len(set(codewords.tolist())) == 4096
    assert min(int(x).bit_count() for x in codewords[1:].tolist()) == 7
    assert set(count.tolist()) == {1, 6}
    words = np.random.default_rng(0).integers(0, 1 << 23, 200)
    for w in words.tolist():
        near = {c for c in codewords.tolist() if (c ^ w).bit_count() <= 3}
        assert len(near) == 1 and near.pop() == w ^ int(patterns[S._syndromes()[w], 0])


def test_rows_hold_the_fingerprint():
    seg = np.random.default_rng(1).integers(0, 1 << 23, (50, 5))
    a, b, row = S.row_keys(seg)
    hi, lo = S.row_fingerprints(a, b)
    want = S.pack(seg)
    assert (hi == want[0][row]).all() and (lo == want[1][row]).all()
    assert (S.unpack(*want) == seg).all()


def flipped(seg, bits, rng):
    out = seg.copy()
    for b in rng.choice(S.BITS, bits, replace=False):
        out[b // 23] ^= 1 << int(b % 23)
    return out


@pytest.mark.parametrize("bits,least", [(S.EXACT, 1.0), (15, 0.97), (S.THRESHOLD, 0.88)])
def test_recall_of_keys(bits, least):
    """No pair up to EXACT bits is missed; beyond, pairs at each distance are found with the stated share."""
    rng = np.random.default_rng(bits)
    n = 300
    seg = rng.integers(0, 1 << 23, (n, 5))
    other = np.array([flipped(s, bits, rng) for s in seg])
    hits = sum(bool(set((S.row_keys(seg[k : k + 1])[0] >> 36).tolist()) & set((S.row_keys(other[k : k + 1])[0] >> 36).tolist())) for k in range(n))
    assert hits / n >= least


def brute(texts, ids):
    seg, triples = S.fingerprints_of(texts)
    hi, lo = S.pack(np.maximum(seg, 0))
    p = S.Prints(hi, lo, triples)
    at = np.flatnonzero(seg[:, 0] >= 0)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i in at:
        for j in at[p.near(at, i)]:
            pairs += i < j
            x, y = sorted((find(int(i)), find(int(j))))
            parent[y] = x
    return {ids[k]: ids[find(k)] for k in range(len(texts)) if find(k) != k}, pairs


def test_groups_match_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    got = docs.select("doc_id", "text").collect()
    want, pairs = brute([r["text"] for r in got], [r["doc_id"] for r in got])
    found = {r["doc_id"]: r["duplicate_of"] for r in S.near_duplicates(docs).collect()}
    assert pairs and len(set(found) & set(want)) >= 0.9 * len(want)
    assert set(found) <= set(want)
    kept = {r["doc_id"] for r in S.deduplicate(docs).collect()}
    assert kept == {r["doc_id"] for r in got} - set(found)


def union(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    return [find(k) for k in range(n)]


def test_no_pair_within_the_exact_radius_is_missed(spark):
    """Every pair up to EXACT bits of the whole table is in one group, and of all verified pairs the stated share."""
    ship(spark)
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").orderBy("doc_id").limit(1000).select("doc_id", "text")
    texts = [r["text"] for r in rows.collect()]
    seg, triples = S.fingerprints_of(texts)
    bits = np.unpackbits(np.ascontiguousarray(seg.astype(">u4")).view(np.uint8).reshape(len(seg), -1), axis=1).astype(np.int32)
    word = bits.sum(1)[:, None] + bits.sum(1) - 2 * bits @ bits.T
    three = np.bitwise_count((triples[:, None] ^ triples[None, :]).view(np.uint64))
    full = (seg[:, 0] >= 0)[:, None] & (seg[:, 0] >= 0)
    root = {r["doc_id"]: r["keep_id"] for r in S.groups(rows).collect()}
    ids = [r["doc_id"] for r in rows.collect()]
    near = np.argwhere(np.triu(full & (word <= S.EXACT) & (three <= S.TRIPLES), 1))
    assert len(near) > 20 and all(root[ids[i]] == root[ids[j]] for i, j in near)
    every = np.argwhere(np.triu(full & (word <= S.THRESHOLD) & (three <= S.TRIPLES), 1))
    assert np.mean([root[ids[i]] == root[ids[j]] for i, j in every]) >= 0.92
    # And nothing else is joined: groups are components of verified pairs.
    joined = union(every.tolist(), len(ids))
    place = {i: k for k, i in enumerate(ids)}
    plain = {t: k for k, t in reversed(list(enumerate(texts)))}
    assert all(joined[k] == joined[place[root[i]]] or texts[k] == texts[place[root[i]]] for k, i in enumerate(ids)) and plain


def test_texts_stay_where_they_are(spark):
    """The plan of the stage has no exchange of a row with its text; beyond the bound the result is the same."""
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = S.deduplicate(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sorted(r["doc_id"] for r in S.deduplicate(docs, max_broadcast=0).collect()) == sorted(r["doc_id"] for r in found.collect())


def test_of_repeated_rows_one_stays_whatever_the_order(spark):
    ship(spark)
    rows = [(1, "some words that repeat", f"s{k}") for k in range(9)] + [(2, "others that do not", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(sorted(map(str, S.deduplicate(df.repartition(n)).collect()))) for n in (1, 4, 7)}
    assert len(got) == 1 and len(got.pop()) == 2


def test_copies_and_strangers(spark):
    ship(spark)
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([60, 200, 2000]))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k in range(40):
        words = texts[k].split()
        for _ in range(max(1, len(words) // 40)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, texts[50]) for k in range(300)]
    gone = {r["doc_id"]: r["duplicate_of"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2000 + k for k in range(300)} <= set(gone) and all(gone[2000 + k] == 50 for k in range(300))
    assert len([k for k in range(40) if gone.get(1000 + k) == k]) >= 38
    assert not [k for k in gone if k < 1000]


def test_equal_words_in_another_order_are_no_copies(spark):
    ship(spark)
    words = [f"word{k}" for k in range(300)]
    mixed = words[:]
    random.Random(1).shuffle(mixed)
    assert S.near_duplicates(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(mixed))], "doc_id long, text string")).collect() == []


def test_a_large_bucket_is_done_in_full():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 23, 5)
    seg = np.array([flipped(base, 4, rng) for _ in range(3000)])
    hi, lo = S.pack(seg)
    u, v = S.bucket_links(np.zeros(3000, np.int64), S.Prints(hi, lo, np.zeros(3000, np.int64)))
    assert len(set(v.tolist())) == 2999


@pytest.mark.parametrize("kind", ["strangers", "pairs", "dense", "mixed"])
def test_links_of_a_bucket_connect_what_all_pairs_do(kind):
    """And they grow with the rows, not with the pairs."""
    rng = np.random.default_rng(7)
    m = 1500
    parts = [rng.integers(-(2**62), 2**62, m) for _ in range(3)]
    if kind == "pairs":
        for x in parts:
            x[1::2] = x[::2] ^ 1
    elif kind == "dense":
        for x in parts:
            x[:] = x[0] ^ (1 << rng.integers(0, 20, m))
    elif kind == "mixed":
        for x in parts:
            x[:400] = x[0] ^ (1 << rng.integers(0, 20, 400))
            x[500:1000:2] = x[501:1001:2] ^ 1
        order = rng.permutation(m)
        parts = [x[order] for x in parts]
    prints = S.Prints(*parts)
    u, v = S.bucket_links(np.zeros(m, np.int64), prints)
    i, j = np.triu_indices(m, 1)
    ok = prints.near(i, j)
    assert union(zip(u.tolist(), v.tolist()), m) == union(zip(i[ok].tolist(), j[ok].tolist()), m)
    assert len(u) <= 8 * m and (len(u) == 0) == (kind == "strangers")


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    found = {r["node"]: r["root"] for r in S.components(chain).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_very_long_text_in_slices():
    words = [f"w{k % 70000}" for k in range(150_000)]
    seg, triples = S.fingerprints_of([" ".join(words), "short text here"])
    assert (seg >= 0).all() and triples[0] != triples[1]
