import json
import os
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quernstone import settings as S
from quernstone.__main__ import main
from quernstone.operators import metrics as M
from quernstone.pipeline import NAMES, SHORT, Pipeline
from quernstone.plans import reports
from quernstone.registry import FORMATS, STAGES, TEMPLATES, Event, Hooks, Registry
from quernstone.sources import client as C
from quernstone.streaming import incremental as I

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(prompt):
    if prompt.startswith("Plan"):
        return json.dumps({"generation_plan": [{"name": n, "concepts": [n + "1", n + "2"], "sample_count": 4, "difficulties": {"beginner": 1, "advanced": 1}} for n in ("alpha", "beta")]})
    if prompt.startswith("Judge"):
        return json.dumps({"verdict": "accept", "severity": "none", "confidence": 0.9})
    about = prompt.split("about: ")[1].split("\n")[0] if "about: " in prompt else "x"
    return "```json\n" + json.dumps({"question": f"What of {about} at {prompt[26:40]}?", "analysis": "the people and the town", "answer": "the people of the town and the house", "metadata": {}}) + "\n```"


@pytest.fixture
def documents(spark):
    words = "people house town river boat winter summer garden market school music letter window bridge".split()
    text = lambda k: " ".join(f"The {words[k % 14]} and the {words[(j * (k + 3)) % 14]} are in the {words[(j + k * 5) % 14]} of this {words[(j * j + k) % 14]}." for j in range(15))
    return spark.createDataFrame([(k, text(k)) for k in range(8)], "doc_id long, text string")


def settings(tmp_path, **verify):
    s = S.Settings(output_dir=str(tmp_path))
    return replace(s, verify=replace(s.verify, judge_models=["a", "b"], **verify), quality_gates=replace(s.quality_gates, max_duplicate_rate=1.0, min_diversity_score=0.1))


def test_whole_run_and_resume(spark, tmp_path, documents):
    seen, hooks = [], Hooks()
    for e in Event:
        hooks.register(e, lambda e=e, **about: seen.append((e, about.get("stage"))))
    hooks.register(Event.STAGE_START, lambda **about: 1 / 0)  # is logged, goes no further
    p = Pipeline(spark, settings(tmp_path), C.Echo(answer), hooks=hooks)
    found = p.run("a topic", run_id="r1", documents=documents)
    assert found.status == "completed" and found.metrics["samples"] == 8 and found.metrics["pass_rate"] == 1.0 and found.metrics["exported"] == 8
    assert [s for e, s in seen if e == Event.STAGE_END] == NAMES[1:]
    assert len((tmp_path / "a_topic_dataset.jsonl").read_text().splitlines()) == 8
    again = Pipeline(spark, settings(tmp_path), C.Echo(lambda x: 1 / 0)).run("a topic", run_id="r1", resume=True)
    assert again.metrics["samples"] == 8


def mended(prompt):
    """A critic that rejects one rewrite, a scorer to whom poor ones are worth little, and a writer that mends what it is told of."""
    tag = next(t for t in ("fatal", "slow", "never") if t in prompt)
    if prompt.startswith("Mend"):
        kind = "good" if tag == "fatal" or tag == "slow" and "too thin" in prompt else "poor"
        return json.dumps({"question": f"{tag} {kind}", "analysis": "the people", "answer": "the house and the town", "metadata": {}})
    poor = f"{tag} poor" in prompt
    if prompt.startswith("Critique"):
        return json.dumps({"issues": ["made up"] if tag == "fatal" else ["too thin"] if poor else [], "severity": "fatal" if tag == "fatal" else "none", "reasoning": "", "passed": tag != "fatal"})
    return json.dumps(dict.fromkeys(("accuracy", "relevance", "completeness"), 0.1 if poor else 1.0))


def test_rewrites_meet_the_bar_of_verification(spark, tmp_path, documents):
    s = settings(tmp_path)
    s = replace(s, verify=replace(s.verify, judge_models=[], critic_model="m"), refine=replace(s.refine, max_retries=2))
    rows = [(t, "reasoning", json.dumps({"question": f"{t} old"}), "revise", 0.5, ["old issue"]) for t in ("fatal", "slow", "never")]
    samples = spark.createDataFrame(rows, "sample_id string, format string, content string, verdict string, quality_score double, issues array<string>").withColumn("content", F.parse_json("content"))
    c = Pipeline(spark, s, C.Echo(mended)).run_stage("refine", "t", documents=documents, samples=samples)
    found = {r["sample_id"]: (r["verdict"], r["attempt"], r["quality_score"], r["issues"]) for r in c.tables["samples"].drop("content").collect()}
    assert found == {"fatal": ("reject", 1, 0.6667, ["made up"]), "slow": ("accept", 2, 1.0, []), "never": ("revise", 2, 0.1, ["too thin"])}


def test_gate_and_budget(spark, tmp_path, documents):
    s = settings(tmp_path)
    with pytest.raises(M.GateFailed) as e:
        Pipeline(spark, replace(s, quality_gates=replace(s.quality_gates, min_diversity_score=1.1)), C.Echo(answer), SHORT).run("t", documents=documents)
    assert [f["gate"] for f in e.value.failed] == ["diversity"]
    with pytest.raises(M.BudgetExceeded):
        Pipeline(spark, replace(s, budget=S.BudgetSettings(max_cost_usd=0.0001)), C.Echo(answer), SHORT).run("t", documents=documents)


def test_single_stage_and_dry_run(spark, tmp_path, documents):
    p = Pipeline(spark, settings(tmp_path))
    assert p.run_stage("clean", "t", documents=documents).tables["cleaned"].count() == 8
    with pytest.raises(ValueError):
        p.run_stage("unheard", "t")
    assert p.dry_run("coding")["samples"] == 150 and p.dry_run()["samples"] == 100
    p.add_stage("count", lambda c: c.info.update(n=c.tables["cleaned"].count()), before="analyze")
    assert [n for n, _ in p.stages][2] == "count"
    p.add_stage("never", lambda c: c.info.update(n=-1), when=lambda c: False)
    assert not p.when["never"](None) and p.stages[-1][0] == "never"


def test_registry():
    r = Registry("thing")
    r.register("a", int)
    assert r.register("b")(str) is str and r.get("a") is int and "b" in r and len(r) == 2 and r.list_all() == {"a": int, "b": str}
    with pytest.raises(ValueError):
        r.register("a", float)
    with pytest.raises(KeyError, match="a, b"):
        r.get("c")
    assert r.discover("quernstone.none") == 0
    assert set(STAGES.list_all()) == set(NAMES) and len(FORMATS) == 6 and len(TEMPLATES) == 3


def test_settings(tmp_path):
    (tmp_path / "q.toml").write_text('output_dir = "t"\n[generate]\nmax_samples = 5\nunknown = 1\n[clean]\nlanguage = "en"\n')
    (tmp_path / ".env").write_text("QUERNSTONE_GENERATE__MAX_SAMPLES=6\nQUERNSTONE_LOG_LEVEL='DEBUG'\n")
    s = S.load(str(tmp_path / "q.toml"), str(tmp_path / ".env"), {"QUERNSTONE_GENERATE__MAX_SAMPLES": "7", "QUERNSTONE_BUDGET__MAX_COST_USD": "1.5", "QUERNSTONE_VERIFY__JUDGE_MODELS": "a, b"})
    assert (s.output_dir, s.generate.max_samples, s.log_level, s.budget.max_cost_usd, s.verify.judge_models) == ("t", 7, "DEBUG", 1.5, ["a", "b"])
    assert S.load("none", "none", {}) == S.Settings()


def test_client():
    class Busy:
        n = 0

        def complete(self, prompt, system, model):
            self.n += 1
            if self.n < 3:
                raise C.RateLimited
            return {"text": '```json\n{"a": 1}\n```'}

    assert C.call(Busy(), "p" * 40, "", "m", wait=0)["tokens_in"] == 10
    assert C.complete_structured(C.Echo(lambda p: '{"a": 1}'), "p", {"required": ["a"]}) == {"a": 1}
    with pytest.raises(ValueError):
        C.complete_structured(C.Echo(lambda p: "[]"), "p", {"required": ["a"]})
    with pytest.raises(C.RateLimited):
        C.call(Busy(), "p", "", "m", attempts=2, wait=0)
    assert C.resolve_model("", "d") == "d" and C.push_credentials({"QUERNSTONE_TEST_KEY": "", "QUERNSTONE_TEST_OTHER": "v"}) == ["QUERNSTONE_TEST_OTHER"]


def test_command_line(spark, tmp_path, capsys):
    assert main(["list-templates"]) == 0 and "coding" in capsys.readouterr().out
    (tmp_path / "d.jsonl").write_text('{"question": "a question", "analysis": "an analysis", "answer": "an answer", "metadata": {}}\nbroken\n{"question": ""}\n')
    assert main(["validate", str(tmp_path / "d.jsonl")], spark) == 0
    out = capsys.readouterr().out
    assert "unreadable_lines  1" in out and "Record 1: missing answer" in out
    assert main(["validate", str(tmp_path / "no.jsonl")], spark) == 1
    assert main(["build", "t", "--dry-run", "--template", "coding"], spark) == 0 and "208000" in capsys.readouterr().out


def test_reports():
    m = {"a": 1, "b": {"<x>": 2}}
    assert json.loads(reports.json_report(m)) == m and "&lt;x&gt;" in reports.html_report(m) and "a  1" in reports.console_summary(m)


def test_stream_dedup(spark, tmp_path):
    src, reg, out = str(tmp_path / "in"), str(tmp_path / "reg"), str(tmp_path / "out")
    base = " ".join(f"word{k}" for k in range(60))
    for part in ([(1, base), (2, base), (3, "another text entirely of its own")], [(4, base), (5, "new words that nobody has seen before")]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        I.dedup_stream(spark.readStream.schema("doc_id long, text string").parquet(src), reg, out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 3, 5]


def test_stream_ledger(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "t string, stage string, cost double").select(F.to_timestamp("t").alias("ts"), "stage", "cost").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, stage string, cost double").parquet(src)
    I.running_cost(stream).writeStream.format("memory").queryName("costs").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["stage"], r["cost"]) for r in spark.table("costs").collect()) == [("a", 3.0), ("b", 4.0)]
