import pytest
from pyspark.sql import functions as F

from quernstone.operators import consistency as S
from quernstone.operators import refine as R
from quernstone.operators import verify as V


def content(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, format string, json string").select("sample_id", "format", F.parse_json("json").alias("content"))


@pytest.mark.parametrize("fmt,json,severity", [
    ("reasoning", '{"question":"q","analysis":"a","answer":"x","metadata":{}}', "none"), ("reasoning", '{"question":"q","analysis":"a","answer":"x"}', "major"),
    ("reasoning", '{"question":"q","analysis":"a"}', "major"), ("reasoning", '{"question":"q"}', "fatal"), ("chat", "{}", "fatal"), ("", "{}", "fatal"),
    ("unheard", '{"question":"q","analysis":"a","answer":"x","metadata":{}}', "none"),
    ("principles", '{"scenario":1,"core_principles":1,"why_rationale":1,"solution":1,"boundary_conditions":1,"metadata":1}', "none"),
])
def test_format_critic(spark, fmt, json, severity):
    r = V.format_critiques(content(spark, [("s", fmt, json)])).first()
    assert (r["severity"], r["passed"]) == (severity, severity == "none")


def test_principles_measured_by_reasoning(spark):
    s = content(spark, [("s", "principles", '{"scenario":1,"metadata":1}')])
    assert V.format_critiques(s, principles=False).first()["severity"] == "fatal"


def test_factual_critic(spark):
    s = content(spark, [("low", "reasoning", '{"answer":"one two three four"}'), ("good", "reasoning", '{"answer":"The Cat sat"}'), ("none", "chat", '{"conversations":[]}'), ("number", "reasoning", '{"answer":5}')])
    docs = spark.createDataFrame([("the cat sat on one mat",)], "text string")
    got = {r["sample_id"]: r["passed"] for r in V.factual_critiques(s, docs).collect()}
    assert got == {"low": False, "good": True, "none": False, "number": False}


def long(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("critiques,scores,verdict,confidence", [
    ([("none", True), ("none", True)], [0.9], "accept", 0.9), ([("none", True), ("minor", False)], [0.7], "revise", 0.35), ([("fatal", True)], [1.0], "reject", 1.0),
    ([], [], "revise", 0.0), ([("none", True)], [0.7], "accept", 0.7), ([], [0.8, 0.6], "accept", 0.7),
])
def test_consensus(spark, critiques, scores, verdict, confidence):
    c = long(spark, [("s", *x) for x in critiques], "sample_id string, severity string, passed boolean")
    o = long(spark, [("s", x) for x in scores], "sample_id string, overall double")
    r = V.consensus(spark.createDataFrame([("s",)], "sample_id string"), c, o).first()
    assert (r["verdict"], r["confidence"]) == (verdict, pytest.approx(confidence))


def test_rate_threshold_is_inclusive(spark):
    c = long(spark, [("s", "none", True), ("s", "minor", False)], "sample_id string, severity string, passed boolean")
    o = long(spark, [("s", 0.7)], "sample_id string, overall double")
    r = V.consensus(spark.createDataFrame([("s",)], "sample_id string"), c, o, min_pass_rate=0.5).first()
    assert (r["verdict"], r["confidence"]) == ("accept", 0.35)


JUDGE = "sample_id string, judge_model string, verdict string, severity string, confidence double, reasoning string"


@pytest.mark.parametrize("judges,verdict,confidence", [
    ([("accept", "none", 0.9), ("accept", "none", 0.7)], "accept", 0.7), ([("accept", "fatal", 0.1), ("accept", "none", 0.99)], "reject", 0.0),
    ([("revise", "none", 0.5), ("accept", "none", 0.9)], "revise", 0.5), ([("reject", "none", 0.5), ("accept", "none", 0.9)], "reject", 0.5),
])
def test_judges(spark, judges, verdict, confidence):
    j = long(spark, [("s", f"m{k}", *x, "why") for k, x in enumerate(judges)], JUDGE)
    r = V.merge_judges(j).first()
    assert (r["verdict"], r["confidence"]) == (verdict, confidence)
    assert len(r["issues"]) == sum(x[0] != "accept" for x in judges)


@pytest.mark.parametrize("agreement,verdict", [(0.34, "accept"), (0.2, "revise"), (None, "accept")])
def test_agreement_counts(spark, agreement, verdict):
    j = long(spark, [("s", "a", "accept", "none", 0.9, ""), ("s", "b", "accept", "none", 0.8, "")], JUDGE)
    c = long(spark, [], "sample_id string, severity string, passed boolean")
    r = V.consensus_with_judges(spark.createDataFrame([("s", agreement)], "sample_id string, agreement_ratio double"), c, j).first()
    assert r["verdict"] == verdict and r["confidence"] == min(0.8, 1.0 if agreement is None else agreement)


def test_raw_texts(spark):
    raw = spark.createDataFrame([("a", "m", '```json\n{"accuracy":0.9,"relevance":0.8,"completeness":0.7}\n```'), ("b", "m", "no json"), ("c", "m", '{"accuracy":1}')], "sample_id string, model string, text string")
    assert {r["sample_id"]: r["overall"] for r in V.parse_scores(raw).collect()} == {"a": 0.81, "b": 0.0, "c": 0.4}
    raw = spark.createDataFrame([("a", "m", '{"issues":["x"],"severity":"minor","passed":false}'), ("b", "m", "no json"), ("c", "n", "{}")], "sample_id string, model string, text string")
    got = {r["sample_id"]: (r["severity"], r["passed"]) for r in V.parse_critiques(raw).collect()}
    assert got == {"a": ("minor", False), "b": ("major", False), "c": ("none", True)}
    assert {r["sample_id"]: (r["verdict"], r["confidence"]) for r in V.judges_from(raw).collect()} == {"a": ("revise", 0.0), "b": ("revise", 0.0), "c": ("revise", 0.0)}
    with pytest.raises(ValueError):
        V.judges_from(raw.where("model = 'm'"))


CAND = "prompt_id string, pos int, candidate_id string, answer_signature string, programmatic_pass boolean"


@pytest.mark.parametrize("candidates,winner,rejected,agreement", [
    ([("42", None), ("42", None), ("7", None)], "c0", ["c1", "c2"], 2 / 3), ([("a", None), ("b", None), ("c", None)], None, ["c0", "c1", "c2"], 1 / 3),
    ([("a", None)], "c0", [], 1.0), ([("42", None), ("42", True), ("7", None)], "c1", ["c0", "c2"], 2 / 3), ([("b", None), ("b", None), ("a", None), ("a", None)], "c0", ["c1", "c2", "c3"], 0.5),
    ([("a", False), ("a", False)], None, [], 0.0), ([("a", False), ("b", None)], "c1", [], 1.0),
])
def test_voting(spark, candidates, winner, rejected, agreement):
    df = spark.createDataFrame([("p", k, f"c{k}", *c) for k, c in enumerate(candidates)], CAND)
    r = S.winners(df).first()
    assert (r["selected_id"], r["rejected_ids"], r["agreement_ratio"]) == (winner, rejected, pytest.approx(agreement))


def test_signatures_and_numbers(spark):
    rows = [("reasoning", '{"answer":" 42. "}'), ("coding", '{"patch":"X"}'), ("chat", '{"conversations":[{"from":"a"}]}'), ("principles", '{"solution":"s"}'), ("agent", "{}")]
    df = spark.createDataFrame(rows, "fmt string, j string").select(S.answer_signature(F.parse_json("j"), F.col("fmt")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["42", "x", '{"from":"a"}', "", ""]
    pairs = spark.createDataFrame([("it is 1/2", "0.5"), ("3", "4"), ("none", "1"), ("2/4", "1/2")], "a string, b string")
    assert [r["p"] for r in pairs.select(S.math_pass(F.col("a"), F.col("b")).alias("p")).collect()] == [True, False, None, True]


def test_refine(spark):
    s = spark.createDataFrame([("a", "revise"), ("b", "accept"), ("c", "revise"), ("d", "revise")], "sample_id string, verdict string")
    rewrite = lambda rows, k: rows.where("sample_id <> 'd'")
    judge = lambda rows, k: rows.select("sample_id", F.when((F.col("sample_id") == "a") & F.lit(k == 2), "accept").otherwise("revise").alias("verdict"))
    got = {r["sample_id"]: (r["verdict"], r["attempt"]) for r in R.refine(s, rewrite, judge).collect()}
    assert got == {"a": ("accept", 2), "b": ("accept", 0), "c": ("revise", 2), "d": ("revise", 0)}


def test_sample_issues(spark):
    rows = [("ok", '{"answer":"a long enough answer here","sample_id":"s","source_documents":["d"],"generation_model":"m"}'), ("bad", '{"answer":"short","x":" "}'), ("own", '{"answer":"","lineage":{"sample_id":"s","source_documents":[],"generation_model":"m"}}')]
    df = spark.createDataFrame(rows, "sample_id string, j string").select("sample_id", F.parse_json("j").alias("content"))
    got = {r["sample_id"]: (r["passed"], len(r["issues"])) for r in V.sample_issues(df, ["answer"]).collect()}
    assert got == {"ok": (True, 0), "bad": (False, 3), "own": (False, 2)}


def test_answers_agree_by_the_whole_signature(spark):
    """Answers that begin alike don't agree; those that differ in case, blanks and final marks do."""
    from quernstone.operators import consistency as C

    answers = [(1, 0, "The cat."), (1, 1, "the dog"), (1, 2, "  The   DOG! "), (2, 0, "a"), (2, 1, "ab"), (3, 0, None)]
    rows = spark.createDataFrame(answers, "prompt_id long, pos int, answer string")
    signed = C.answer_signature(F.to_variant_object(F.struct("answer")), F.lit("reasoning"))
    found = rows.select("prompt_id", "pos", F.concat_ws("-", "prompt_id", "pos").alias("candidate_id"), signed.alias("answer_signature"), F.lit(None).cast("boolean").alias("programmatic_pass"))
    assert {(r["prompt_id"], r["answer_signature"], r["size"]) for r in C.clusters(found).collect()} == {(1, "the dog", 2), (1, "the cat", 1), (2, "a", 1), (2, "ab", 1), (3, "", 1)}
    assert {r["prompt_id"]: r["selected_id"] for r in C.winners(found).collect()} == {1: "1-1", 2: None, 3: "3-0"}


def test_missing_scores_and_judges(spark):
    """Samples without critiques, scores or judges, which the queries' tables don't have."""
    from quernstone.operators import verify as V

    samples = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "sample_id long, agreement_ratio double")
    critiques = spark.createDataFrame([(1, "m", True, "none")], "sample_id long, critic_model string, passed boolean, severity string").withColumn("issues", F.array().cast("array<string>"))
    scores = spark.createDataFrame([(1, 0.9), (2, 0.9)], "sample_id long, overall double")
    assert {r["sample_id"]: (r["verdict"], r["confidence"]) for r in V.consensus(samples, critiques, scores).collect()} == {1: ("accept", 0.9), 2: ("accept", 0.9), 3: ("revise", 0.0)}
    judges = spark.createDataFrame([(1, "j", "accept", "none", 0.8, "")], "sample_id long, judge_model string, verdict string, severity string, confidence double, reasoning string")
    assert {r["sample_id"]: r["verdict"] for r in V.consensus_with_judges(samples, critiques, judges).collect()} == {1: "accept", 2: "revise", 3: "revise"}


def test_answers_without_grounding(spark):
    from quernstone.operators import verify as V

    samples = spark.createDataFrame([(1, '{"answer": "known words here"}'), (2, '{"answer": "zq zw ze known"}'), (3, '{"answer": ""}')], "sample_id long, record string").select("sample_id", F.parse_json("record").alias("content"))
    found = {r["sample_id"]: (r["severity"], r["passed"]) for r in V.factual_critiques(samples, spark.createDataFrame([("Known words HERE",), (None,)], "text string")).collect()}
    assert found == {1: ("none", True), 2: ("major", False), 3: ("major", False)}
