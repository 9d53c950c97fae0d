import duckdb
import pytest

from quernstone.llm import mixing as M
from quernstone.llm._common import ship
from tests.conftest import SF


def fill(sizes, weights, epochs, budget):
    """Water-filling by rounds: clamp, share out again among the rest, until none is over."""
    caps = {k: epochs * n for k, n in sizes.items()}
    budget = min(budget, sum(caps[k] for k in sizes if weights.get(k, 0) > 0))
    clamped = {}
    while True:
        rest = {k: weights[k] for k in sizes if weights.get(k, 0) > 0 and k not in clamped}
        left = budget - sum(clamped.values())
        if not rest:
            break
        share = {k: left * w / sum(rest.values()) for k, w in rest.items()}
        over = [k for k in rest if share[k] > caps[k] + 1e-9]
        if not over:
            return {k: clamped.get(k, share.get(k, 0.0)) for k in sizes}
        clamped |= {k: caps[k] for k in over}
    return {k: clamped.get(k, 0.0) for k in sizes}


@pytest.mark.parametrize("weights,epochs,budget", [
    ({"a": 1, "b": 1, "c": 1, "d": 1}, 4.0, None), ({"a": 5, "b": 1}, 2.0, None), ({"a": 1, "b": 100, "c": 3, "d": 0.5}, 1.5, 900.0),
    ({"a": 1, "b": 1, "c": 1, "d": 1}, 1.0, 1e9), ({"z": 1}, 4.0, None), ({}, 4.0, None),
])
def test_shares_match_rounds_of_clamping(spark, weights, epochs, budget):
    sizes = {"a": 1000, "b": 10, "c": 200, "d": 100}
    docs = spark.createDataFrame([(k, s, "x" * 10) for s, n in sizes.items() for k in range(n // 10)], "doc_id long, source string, text string")
    got = {r["source"]: r["allocated"] for r in M.shares(docs, weights, epochs, budget).collect()}
    want = fill(sizes, weights, epochs, budget if budget is not None else sum(sizes.values()))
    assert got == pytest.approx(want)


def test_repetitions_are_seeded_and_meet_the_epochs(spark):
    ship(spark)
    docs = spark.createDataFrame([(k, "big" if k % 10 else "small", "x" * 50) for k in range(5000)], "doc_id long, source string, text string")
    rows = M.repetitions(docs).collect()
    for s in ("big", "small"):
        own = [r for r in rows if r["source"] == s]
        epochs = own[0]["epochs"]
        assert {r["repetitions"] for r in own} <= {int(epochs), int(epochs) + 1}
        assert sum(r["repetitions"] for r in own) / len(own) == pytest.approx(epochs, abs=0.05)
    assert sorted(map(str, rows)) == sorted(map(str, M.repetitions(docs.repartition(7)).collect()))
    times = {r["doc_id"]: r["repetitions"] for r in rows}
    mixed = [r["doc_id"] for r in M.mix(docs).collect()]
    assert len(mixed) == sum(times.values()) and all(mixed.count(k) == times[k] for k in range(0, 5000, 500))


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, source, repetitions, epochs FROM ({M.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in M.repetitions(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "source", "repetitions", "epochs").collect()]
    assert sorted(got) == sorted(want)


def test_documents_stay_in_place_and_many_sources_give_the_same(spark, monkeypatch):
    """Up to the bound the plan broadcasts sources and moves no document; beyond it the result is the same."""
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = M.mix(docs)
    want = sorted(map(str, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(M, "MAX_BROADCAST", 0)
    assert sorted(map(str, M.mix(docs).collect())) == want


@pytest.mark.parametrize("bad", [{"weights": {"a": -1.0}}, {"weights": {"a": float("nan")}}, {"max_epochs": -1.0}, {"budget": float("inf")}])
def test_senseless_weights_are_errors(spark, bad):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    with pytest.raises(ValueError):
        M.shares(docs, **bad)
