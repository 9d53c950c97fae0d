import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import web as W
from quernstone.operators import collect as K
from quernstone.operators import metrics as M
from quernstone.operators import validate as V
from quernstone.plans import catalog
from quernstone.sources import datasets as D
from quernstone.sources.code import check_code, run_tests
from quernstone.sources.store import ParquetStore
from tests.conftest import SF


def records(spark, *rows):
    return spark.createDataFrame([(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], "idx long, record string")


GOOD = {"question": "a question", "analysis": "an analysis", "answer": "an answer", "metadata": {}}


def test_schema_errors(spark):
    assert V.schema_errors(records(spark, {}), "reasoning").count() == 4
    r = records(spark, GOOD | {"question": "", "analysis": [], "answer": None}, GOOD | {"question": 0, "analysis": False, "answer": {}})
    assert sorted((x["idx"], x["kind"], x["key"]) for x in V.schema_errors(r, "reasoning").collect()) == [(0, "empty", "analysis"), (0, "empty", "answer"), (0, "empty", "question")]
    assert V.schema_errors(records(spark, GOOD), "unheard").count() == 1
    assert V.report(records(spark, GOOD), "unheard").first()["valid"] == 1
    assert len(V.available_formats()) == 6
    with pytest.raises(ValueError):
        V.for_format("unheard")


def test_completeness_and_consistency(spark):
    short = V.completeness_errors(records(spark, {"a": "Hi ", "b": "Yes", "c": "Hello", "metadata": "x", "n": 1}, {})).collect()
    assert sorted((r["idx"], r["kind"], r["key"] or "", r["detail"] or "") for r in short) == [(0, "too short", "a", "3"), (0, "too short", "b", "3"), (1, "empty record", "", "")]
    diff = V.consistency_errors(records(spark, {"a": 1, "b": 1}, {"a": 1, "c": 1}, {"b": 2, "a": 1})).collect()
    assert sorted((r["idx"], r["kind"], r["detail"]) for r in diff) == [(1, "extra keys", "c"), (1, "missing keys", "b")]
    assert V.lineage_warnings(records(spark, {"metadata": "x"}, {"metadata": {}}, {}, {"metadata": None})).count() == 2


def test_report(spark):
    r = V.report(records(spark, GOOD, GOOD, {"question": "only one"}), "reasoning").first()
    assert (r["total"], r["valid"], r["pass_rate"]) == (3, 2, 0.6667)
    assert V.report(records(spark).limit(0), "reasoning").first()["pass_rate"] == 0.0


def test_jsonl_and_parquet(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b.jsonl").write_text('{"k": 3}\n')
    (tmp_path / "d/a.jsonl").write_text('{"k": 1}\n\n  broken\n{"k": 2, "x": null}\n')
    (tmp_path / "d/c.txt").write_text('{"k": 9}\n')
    at = str(tmp_path / "d")
    assert [json.loads(r["record"])["k"] for r in D.indexed(D.from_directory(spark, at)).orderBy("idx").collect()] == [1, 2, 3]
    assert [(r["file"].rpartition("/")[2], r["line"], r["record"]) for r in D.bad_lines(spark, at).collect()] == [("a.jsonl", 3, "broken")]
    assert [(r["file"].rpartition("/")[2], r["line"]) for r in D.from_directory(spark, at).collect()] == [("a.jsonl", 1), ("a.jsonl", 4), ("b.jsonl", 1)]
    (tmp_path / "d/e").mkdir()
    (tmp_path / "d/e/a.jsonl").write_text('{"k": 4}\n')
    both = spark.read.option("recursiveFileLookup", "true").text([at]).count()
    assert both and D.indexed(D.from_jsonl(spark, at).unionByName(D.from_jsonl(spark, f"{at}/e"))).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        D.from_jsonl(spark, str(tmp_path / "no.jsonl")).collect()
    df = spark.createDataFrame([(1, None, [1, 2], {"a": "ü"})], "i int, n string, l array<int>, m map<string,string>")
    D.to_jsonl(df, str(tmp_path / "o.jsonl"))
    assert json.loads(D.from_jsonl(spark, str(tmp_path / "o.jsonl")).first()["record"]) == {"i": 1, "n": None, "l": [1, 2], "m": {"a": "ü"}}
    many = spark.range(1000).repartition(5).orderBy("id")
    for _ in range(2):  # the second replaces the first
        D.to_jsonl(many, str(tmp_path / "one.jsonl"), one_file=True)
    assert (tmp_path / "one.jsonl").is_file() and [json.loads(x)["id"] for x in (tmp_path / "one.jsonl").read_text().splitlines()] == list(range(1000))
    assert not list(tmp_path.glob("one.jsonl.parts*"))
    D.to_parquet(df, str(tmp_path / "o.parquet"))
    assert D.from_parquet(spark, str(tmp_path / "o.parquet")).first().asDict() == {"i": 1, "n": None, "l": "[1,2]", "m": '{"a":"ü"}'}
    with pytest.raises(NotImplementedError):
        D.to_hub(df, "x/y")


@pytest.mark.parametrize("n,sizes", [(10, (8, 1, 1)), (7, (5, 0, 2)), (15, (12, 1, 2)), (0, (0, 0, 0))])
def test_splits(spark, n, sizes):
    got = D.with_splits(spark.range(n).withColumnRenamed("id", "doc_id")).groupBy("split").count().collect()
    by = {r["split"]: r["count"] for r in got}
    assert tuple(by.get(k, 0) for k in ("train", "validation", "test")) == sizes
    with pytest.raises(ValueError):
        D.with_splits(spark.range(3), 0.8, 0.1, 0.2)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "accept"), (2, "reject"), (3, "revise"), (4, None)], "k int, verdict string").withColumn("content", F.to_variant_object(F.struct("k")))
    assert D.export(df, "a topic/x", str(tmp_path)) == 3
    assert sorted(json.loads(r["value"])["k"] for r in spark.read.text(str(tmp_path / "a_topic_x_dataset.jsonl")).collect()) == [1, 3, 4]
    assert (tmp_path / "a_topic_x_dataset.jsonl").is_file() and json.loads((tmp_path / "a_topic_x_metadata.json").read_text())["total_samples"] == 3
    assert D.export(df, "parts", str(tmp_path), one_file=False) == 3 and (tmp_path / "parts_dataset.jsonl").is_dir()
    assert D.export(df.limit(0), "none", str(tmp_path)) == 0 and not (tmp_path / "none_dataset.jsonl").exists()


def test_lines_of_a_file_that_is_read_in_blocks(spark, tmp_path):
    """Line numbers run over the blocks of a file."""
    at = tmp_path / "big.jsonl"
    at.write_text("".join("\n" if k % 7 == 0 else f'{{"k": {k}, "pad": "{"x" * (k % 90)}"}}\n' for k in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(at)).rdd.getNumPartitions() > 3
        got = {json.loads(r["record"])["k"]: r["line"] for r in D.from_jsonl(spark, str(at)).collect()}
        assert got == {k: k for k in range(1, 3001) if k % 7}
        assert [json.loads(r["record"])["k"] for r in D.indexed(D.from_jsonl(spark, str(at))).orderBy("idx").collect()] == [k for k in range(1, 3001) if k % 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_store(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id string, data string")
    assert s.load("c", "a") is None and s.list("c") == []
    s.save("c", rows(("a", "1"), ("b", "2")))
    s.save("c", rows(("a", "3")))
    assert s.load("c", "a") == "3" and s.list("c") == ["a", "b"]
    s.delete("c", "a")
    assert s.load("c", "a") is None and s.list("c") == ["b"]
    s.save_state("r", "x")
    s.save_state("r", "y")
    assert s.load_state("r") == "y" and s.load_state("q") is None
    s.save_blob("d/f.bin", b"\0\1")
    assert s.load_blob("d/f.bin") == b"\0\1" and s.blobs().count() == 1
    with pytest.raises(ValueError):
        s.save_blob("../../x", b"")


@pytest.mark.parametrize("subtopics,want", [("aabb", 1.0), ("aaaa", 0.0), ("a", 0.0), ("", 0.0)])
def test_topic_entropy(spark, subtopics, want):
    df = spark.createDataFrame([(c, "x") for c in subtopics], "subtopic string, difficulty string")
    assert M.topic_entropy(df).first()[0] == pytest.approx(want)


def test_balance_and_uniqueness(spark):
    d = spark.createDataFrame([("a",)] * 3 + [("b",)], "difficulty string")
    assert M.difficulty_balance(d).first()[0] == 0.5 == M.difficulty_balance(d.where("difficulty = 'a'")).first()[0]
    q = spark.createDataFrame([("Same " + "x" * 60,), ("same " + "x" * 61,), ("other",)], "question string")
    assert M.prompt_uniqueness(q).first()[0] == pytest.approx(2 / 3)
    none = spark.createDataFrame([], "subtopic string, difficulty string, question string")
    assert tuple(M.diversity(none).first()) == (0.0, 0.0, 0.0, 0.0)


def gate(spark, total, dup, div, rate, cost, **limits):
    row = spark.createDataFrame([(total, dup, div, rate, cost)], "total long, duplicates long, diversity double, pass_rate double, cost double")
    return sorted(r["gate"] for r in M.failed_gates(row, M.Limits(**limits)).collect())


def test_gates(spark):
    assert gate(spark, 100, 8, 0.9, 0.9, 1.0) == []
    assert gate(spark, 100, 8, 0.9, 0.9, 1.0, max_duplicate_rate=0.05) == ["duplicates"]
    assert gate(spark, 0, 0, 0.1, 0.59999, 2.0, max_cost=1.0) == ["budget", "diversity", "verification"]


def test_budget(spark):
    b = M.Budget(0.05)
    b.record(1, 1, "m", 0.03, "s")
    with pytest.raises(M.BudgetExceeded) as e:
        b.record(1, 1, "m", 0.03, "s")
    assert (e.value.spent, e.value.stage) == (pytest.approx(0.06), "s") and b.remaining == 0.0
    rows = M.running(b.ledger(spark), 0.05, ["seq"]).orderBy("seq").collect()
    assert [(round(r["spent"], 4), r["over"]) for r in rows] == [(0.03, False), (0.06, True)]
    assert M.cost_by(b.ledger(spark), "stage").first()["calls"] == 2


def test_running_total_of_a_hot_time(spark):
    """A third of all rows share one time: ranges cut it, and the total is that of one sequence."""
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(1)
    t = datetime(2024, 1, 1)
    rows = [(t if k % 3 == 0 else t + timedelta(seconds=rnd.randint(-5000, 5000)), k, float(rnd.randint(0, 9))) for k in range(2000)] + [(None, 3000, 1.0)]
    found = M.running(spark.createDataFrame(rows, "ts timestamp, seq long, cost double"), 500.0)
    got = {r["seq"]: r for r in found.collect()}
    total = 0.0
    for ts, seq, cost in sorted(rows, key=lambda r: (r[0] is not None, r[0] or t, r[1])):
        total += cost
        assert got[seq]["spent"] == total and got[seq]["over"] == (total > 500)
    assert M.running(spark.createDataFrame([], "ts timestamp, seq long, cost double"), 1.0).collect() == []


def test_benchmark(spark):
    df = spark.createDataFrame([("accept", 0.9, []), ("revise", None, ["x" * 100, "y"]), ("reject", 0.5, ["y"]), (None, None, None)], "verdict string, quality_score double, issues array<string>")
    assert tuple(M.benchmark(df).first()) == (4, 1, 1, 0.25, 0.7)
    assert {r["reason"]: r["samples"] for r in M.failure_reasons(df).collect()} == {"x" * 80: 1, "y": 2}


def test_web(spark):
    urls = ["https://www.facebook.com/x", "http://m.facebook.com", "http://notfacebook.com", "no url", None, "HTTP://WWW.Reddit.COM/r"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r["b"] for r in df.select(W.is_blocked(F.col("u")).alias("b")).collect()] == [True, True, False, False, False, True]
    types = [("http://a/x.PDF", ""), ("http://a/x.md", ""), ("http://a", "Text/HTML"), ("http://a/x.pdf", "application/json"), ("http://a", "text/csv")]
    df = spark.createDataFrame(types, "u string, h string")
    assert [r["t"] for r in df.select(W.content_type(F.col("u"), F.col("h")).alias("t")).collect()] == ["application/pdf", "text/plain", "text/html", "application/json", "text/plain"]
    page = "<html><head><title> A &amp; B </title><style>x{}</style></head><body><nav>menu <b>x</b></nav><!-- c --><p>One &lt;two&gt;</p><script>1<2</script> <br>three<footer>f</footer></body></html>"
    assert W.html_to_text(page) == "A & B\nOne <two>\nthree" and W.html_to_text(None) is None and W.html_to_text("") == ""
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(W.html_title(F.col("h"))).first()[0] == "A &amp; B" and df.select(W.main_text(F.col("h"))).first()[0] == "One <two>\nthree"
    links = '<a href="/l/?uddg=https%3A%2F%2Fa.org%2Fx&amp;r=1">a</a><a href="https://b.org">b</a><a href="/c">c</a><a href="https://b.org">b</a>'
    got = K.search_urls(spark.createDataFrame([("q", links), ("r", None)], "query string, html string")).collect()
    assert [(r["pos"], r["url"]) for r in got] == [(0, "https://a.org/x"), (1, "https://b.org")]
    asked = spark.createDataFrame([("t", '["a","b"]'), ("u", "{}"), ("v", "?")], "topic string, text string")
    assert sorted((r["topic"], r["query"]) for r in K.search_queries(asked).collect()) == [("t", "a"), ("t", "b"), ("u", "u"), ("v", "v"), ("v", "v examples"), ("v", "v guide")]


def test_code(spark):
    assert run_tests("def f(x): return x + 1", "assert f(1) == 2") is True
    assert run_tests("def f(x): return x", "assert f(1) == 2") is False
    assert run_tests("x", "") is None and run_tests("while True: pass", "1", timeout=0.5) is False
    df = spark.createDataFrame([("a", "x = 1", "assert x == 1"), ("b", "", None)], "candidate_id string, code string, tests string")
    with pytest.raises(PermissionError):
        check_code(df)
    assert {r["candidate_id"]: r["programmatic_pass"] for r in check_code(df, allow=True).collect()} == {"a": True, "b": None}


@pytest.mark.parametrize("name, source", [("stream_dedup", "documents"), ("stream_ledger", "events")])
def test_streams_of_tables_in_parts(spark, tmp_path, name, source):
    """A table may be a folder of parts, as larger ones are."""
    spark.read.parquet(f"{SF}/{source}.parquet").repartition(3).write.parquet(str(tmp_path / f"{source}.parquet"))
    key = lambda r: repr([round(v, 4) if isinstance(v, float) else v for v in r])
    of = lambda at: sorted(map(key, catalog.queries()[name](spark, at).collect()))
    assert of(str(tmp_path)) == of(SF) != []


def test_pages_are_parsed_once(spark):
    """Not once for the filter on length and again for what is selected."""
    found = catalog.queries()["page_word_filter"](spark, SF)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert found.count()
