import pytest
from pyspark.sql import functions as F

from quernstone.operators import formats as R
from quernstone.operators import generate as G
from quernstone.operators import trajectories as X
from quernstone.plans import templates as P

RESP = "call_id string, model string, text string, concept string, name string, level string, source_ids array<string>"


def loops(plan, most, batch):
    """The expansion as nested loops when every answer is usable."""
    left, out = min(most, sum(p[2] for p in plan)), []
    for name, concepts, _, levels in plan:
        for c in concepts or [name]:
            for level, n in levels:
                b = min(n, left, batch)
                if b <= 0:
                    break
                out.append((name, c, level, b))
                left -= b
    return out


@pytest.mark.parametrize("most,batch", [(100, 10), (7, 10), (5, 2), (0, 10)])
def test_expand_matches_loops(spark, most, batch):
    plan = [("a", ["x", "y"], 10, [("b", 3), ("i", 4), ("a", 3)]), ("n", [], 4, [("b", 2), ("i", 0), ("a", 9)]), ("z", ["q"], 6, [("b", 12)])]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(plan)], "plan_pos int, name string, concepts array<string>, sample_count int, difficulties array<struct<level: string, cnt: int>>")
    rows = G.expand(df, most, batch).where("batch > 0").orderBy("plan_pos", "concept_pos", "level_pos").collect()
    assert [(r["name"], r["concept"], r["level"], r["batch"]) for r in rows] == loops(plan, most, batch)


def test_plans_are_parsed_or_defaulted(spark):
    good = '```json\n{"generation_plan":[{"name":"n","concepts":["c"],"sample_count":5,"difficulties":{"easy":2}},{"name":"m"}]}\n```'
    rows = G.parse_plan(spark.createDataFrame([("t", good), ("u", "nonsense"), ("v", "```")], "topic string, text string")).orderBy("topic", "plan_pos").collect()
    assert [(r["topic"], r["name"], r["concepts"], r["sample_count"], [tuple(d) for d in r["difficulties"]]) for r in rows] == [
        ("t", "n", ["c"], 5, [("easy", 2)]), ("t", "m", [], 10, G.DIFFICULTIES), ("u", "u", ["u"], 10, G.DIFFICULTIES), ("v", "v", ["v"], 10, G.DIFFICULTIES),
    ]


FALLBACK_IS_VALID = {"instruction", "chat"}


@pytest.mark.parametrize("fmt", R.FIELDS)
@pytest.mark.parametrize("text", ["not json", "[1]", "```", ""])
def test_fallbacks(spark, fmt, text):
    r = G.to_samples(spark.createDataFrame([("c", "m", text, "concept", "topic", "easy", ["d"])], RESP), fmt).select("valid", F.to_json("content").alias("j"), "lineage").first()
    assert r["valid"] == (fmt in FALLBACK_IS_VALID and text != "")
    assert "concept" in r["j"] and r["lineage"]["format"] == fmt and r["lineage"]["source_documents"] == ["d"]


@pytest.mark.parametrize("fmt,text,valid", [
    ("reasoning", '{"question":"q","analysis":"a","answer":"x"}', True), ("reasoning", '{"question":"q","analysis":"a","answer":0}', False), ("coding", '{"issue":"i","investigation":"v","patch":"p"}', True),
    ("agent", '{"observation":"o","thought":"t","action":{},"result":"r"}', False), ("agent", '{"observation":"o","thought":"t","action":{"tool":"x"},"result":"r"}', True),
    ("chat", '{"conversations":[{"from":"human","value":"a"}]}', False), ("chat", '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', True),
    ("instruction", '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":""}]}', False), ("chat", '{"conversations":"x"}', False),
    ("principles", '{"scenario":"s","core_principles":["p"],"why_rationale":"w","solution":"s","boundary_conditions":["b"]}', True),
])
def test_required_fields(spark, fmt, text, valid):
    assert G.to_samples(spark.createDataFrame([("c", "m", text, "concept", "topic", "easy", ["d"])], RESP), fmt).first()["valid"] == valid


def test_plan_overrides_metadata(spark):
    text = '{"question":"q","analysis":"a","answer":"x","metadata":{"difficulty":"wrong","confidence":1}}'
    r = G.to_samples(spark.createDataFrame([("c", "m", text, "concept", "topic", "easy", ["d"])], RESP), "reasoning").select(F.to_json("content").alias("j")).first()["j"]
    import json

    assert json.loads(r)["metadata"] == {"difficulty": "easy", "subtopic": "topic", "confidence": 1}


def test_self_consistent(spark):
    rows = [("p", k, f"p{k}", "m", f'{{"question":"q","analysis":"a{k}","answer":"{a}"}}', "c", "n", "easy", ["d"]) for k, a in enumerate(["1", "2", "2"])] + [("q", 0, "q0", "m", "broken", "c", "n", "easy", ["d"])]
    df = spark.createDataFrame(rows, f"prompt_id string, pos int, {RESP}")
    got = G.self_consistent(df, "reasoning").select("prompt_id", "sample_id", "agreement_ratio").collect()
    assert [(r["prompt_id"], r["sample_id"], round(r["agreement_ratio"], 4)) for r in got] == [("p", "p1", 0.6667)]


def test_context_samples(spark):
    chunks = spark.createDataFrame([(k, 0, f"t{k}") for k in range(5)], "doc_id long, pos int, chunk string")
    cells = spark.createDataFrame([(k,) for k in range(4)], "cell int")
    got = G.context_sample(cells, chunks, ["cell"]).collect()
    assert len(got) == 4 and all(len(set(r["source_ids"])) == 3 and r["context"] == "\n\n".join(f"t{i}" for i in r["source_ids"]) for r in got)
    # Cells draw on their own: 40 cells over 6 chunks meet, and each chunk comes up about as often.
    many = spark.createDataFrame([(k,) for k in range(40)], "cell int")
    six = spark.createDataFrame([(k, 0, f"t{k}") for k in range(6)], "doc_id long, pos int, chunk string")
    drawn = [tuple(sorted(r["source_ids"])) for r in G.context_sample(many, six, ["cell"]).collect()]
    seen = [sum(k in d for d in drawn) for k in range(6)]
    assert len(drawn) == 40 and 10 < len(set(drawn)) <= 20 and min(seen) >= 8 and sum(seen) == 120
    assert [len(r["source_ids"]) for r in G.context_sample(cells, chunks.limit(2), ["cell"]).collect()] == [2] * 4
    assert G.context_sample(cells, chunks.limit(0), ["cell"]).collect() == []


def test_trajectories(spark):
    steps = spark.createDataFrame([(1, "t", 1, "o1", "h1", "tool", '{"a":1}', "r1"), (1, "t", 0, "o0", "h0", "tool", "{}", "r0")], "traj_id int, task string, pos int, observation string, thought string, tool string, input string, result string")
    made = X.record(steps)
    react = X.to_react(made).first()["messages"]
    assert [m["role"] for m in react] == ["system", "user", "assistant", "user", "assistant"] and react[1]["content"] == "Observation: o0"
    assert react[4]["content"] == 'Thought: h1\nAction: tool({"a":1})\nResult: r1'
    chat = X.to_chatml(made).first()["messages"]
    assert [m["role"] for m in chat] == ["system", "user", "assistant", "tool"] + ["user", "assistant", "tool"]
    assert chat[2]["tool_calls"][0]["function"]["name"] == "tool" and chat[3]["name"] == "tool"
    assert "null" not in X.messages_json(X.to_chatml(made)).first()["record"]
    with pytest.raises(PermissionError):
        X.run_command("echo hi")
    assert X.run_command("echo hi", allow=True).strip() == "hi"
    assert len(X.run_command("head -c 20000 /dev/zero | tr '\\0' x", allow=True)) == X.MAX_OUTPUT + len(X._MARK)


def test_dry_run(spark):
    r = {x["template"]: x for x in P.dry_run(P.as_table(spark)).collect()}
    assert (r["cybersecurity"]["pages"], r["cybersecurity"]["documents"], r["cybersecurity"]["samples"], r["cybersecurity"]["tokens"], r["cybersecurity"]["minutes"]) == (50, 20, 200, 273_000, 11)
    assert r["cybersecurity"]["cost"] == 6.09 and r["reasoning"]["minutes"] == 6 and r["coding"]["minutes"] == 8
    assert [len(t[4]) for t in P.TEMPLATES.values()] == [17, 12, 14]


def test_expand_runs_up_in_ranges(spark):
    """Cells of a large plan aren't one task's, and their batches are the same as in one sequence."""
    levels = F.array(F.struct(F.lit("a").alias("level"), (F.col("id") % 4).cast("int").alias("cnt")), F.struct(F.lit("b").alias("level"), F.lit(7).alias("cnt")))
    plan = spark.range(3000).select(F.col("id").alias("plan_pos"), F.lit("n").alias("name"), F.array(F.lit("c")).alias("concepts"), F.lit(2).alias("sample_count"), levels.alias("difficulties"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = G.expand(plan, 5000, 5).withColumn("task", F.spark_partition_id()).orderBy("plan_pos", "level_pos").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    left, want = 5000, []
    for k in range(3000):
        for n in (k % 4, 5 if k % 4 else 0):
            want.append(min(n, left))
            left -= want[-1]
    assert [r["batch"] for r in got] == want and left == 0
    assert len({r["task"] for r in got}) > 1


@pytest.mark.parametrize("fmt", R.FIELDS)
def test_a_text_is_stripped_once_and_parsed_few_times(spark, fmt):
    """Fields are looked up in one parsed record, not in a text parsed for each."""
    made = G.to_samples(spark.createDataFrame([("c", "m", "{}", "concept", "topic", "easy", ["d"])], RESP), fmt)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") <= 3 and plan.count("regexp_replace(") <= 1
