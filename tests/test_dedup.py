import pytest
from pyspark.sql import functions as F

from quernstone.operators import dedup as D

BIG = "/root/testdata/sf0.01"


def sequential(rows, distance=3):
    """The greedy rule, straight from its words."""
    kept, out = [], {}
    for k, t in rows:
        fp = D.fingerprint(t) & (1 << 64) - 1
        exact = next((i for i, u, _ in kept if u == t), None)
        near = next(((i, f) for i, _, f in kept if (f ^ fp).bit_count() <= distance), None)
        if exact is not None:
            out[k] = (True, "exact", exact, 1.0)
        elif near is not None:
            out[k] = (True, "simhash", near[0], 1 - (near[1] ^ fp).bit_count() / 64)
        else:
            out[k] = (False, None, None, None)
            kept.append((k, t, fp))
    return out


def test_fingerprints():
    assert D.fingerprint("...") == 0 and D.fingerprint(None) is None
    assert D.fingerprint("foo") == -5999611798422882212 and D.fingerprint("foo") & (1 << 64) - 1 == 12447132275286669404


@pytest.mark.parametrize("rows", [
    [(1, "A"), (2, "A"), (3, "A")], [(1, ""), (2, "!"), (3, "?"), (4, "")], [],
    [(k, " ".join(f"w{j}" for j in range(200) if j != k % 7)) for k in range(30)], [(1, None), (2, "b")],
])
def test_greedy_rule(spark, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in D.greedy(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == sequential([r for r in rows if r[1] is not None])


def test_greedy_on_documents(spark, read):
    docs = read("documents")
    want = sequential([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    assert {r["doc_id"]: tuple(r)[1:] for r in D.greedy(docs.repartition(3)).collect()} == want


def test_anchors(spark, read):
    docs = read("documents", BIG)
    r = D.report(D.greedy(docs)).first()
    assert (r["total"], r["exact_duplicates"], r["near_duplicates"], r["unique"]) == (1000, 71, 85, 844)
    of = {r["doc_id"]: r for r in D.near_classes(docs).collect()}
    size = {r["class_id"]: r["copies"] for r in of.values()}
    pairs = D.near_pairs(docs).collect()
    # Between documents these are 309 pairs: within classes, and between those of two classes.
    assert sum(n * (n - 1) // 2 for n in size.values()) + sum(r["copies_a"] * r["copies_b"] for r in pairs) == 309
    assert len(of) == 1000 == sum(size.values()) and all(size[r["a"]] == r["copies_a"] and size[r["b"]] == r["copies_b"] and r["a"] < r["b"] for r in pairs)
    assert all(of[k]["links"] == sum(k in (r["a"], r["b"]) for r in pairs) for k in size)
    assert D.keep(docs).count() == 844


def test_chain(spark):
    """A node near only to a dropped one stays."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "e long, l long")
    assert sorted(r["node"] for r in D._settle(edges).collect()) == list(range(1, 21, 2))


@pytest.mark.parametrize("distance", [0, 3, 6])
def test_near_pairs_are_exact(spark, distance):
    import random

    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 8))) for x in base for _ in range(5)}
    df = spark.createDataFrame([(D._signed(x),) for x in fps], "fp long")
    got = {(r["fp"], r["other"]) for r in D.near_fingerprints(df, distance=distance).collect()}
    signed = sorted(map(D._signed, fps))
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert got == want


@pytest.mark.parametrize("probes", [False, True])
def test_exploded_keys_are_not_broadcast(spark, probes):
    """Spark's estimate leaves out the 20 keys of a fingerprint, so a small table of fingerprints made a large broadcast."""
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    found = D.near_fingerprints(fps, fps.limit(100) if probes else None)
    assert found.count() == 100 * probes
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_probes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "z")], "doc_id long, text string")
    probe = spark.createDataFrame([(9, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in D.near_matches(probe, docs).collect()] == [(9, 1, 2, 0)]
    assert D.is_registered(docs, probe).count() == 2


def test_exact_duplicates_of_a_hot_text(spark):
    rows = [(k, "a much copied text" if k % 3 else f"own {k}") for k in range(60)] + [(60, None), (61, None), (62, ""), (63, "")]
    got = {r["doc_id"]: r["duplicate_of"] for r in D.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 1 for k in range(2, 60) if k % 3} | {63: 62}
    assert D.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
