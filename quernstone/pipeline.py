"""The dataset pipeline: named stages from DataFrame to DataFrame, with hooks, a state for resuming, budget and gates.

Stages share a context. Each stage's result is written to the store's folder and read back, so a stage is computed once and a
run that broke off goes on behind its last whole stage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import clean, collect, dedup, formats, generate, metrics, refine, verify
from quernstone.plans import templates
from quernstone.registry import FORMATS, STAGES, TEMPLATES, Event, Hooks
from quernstone.settings import Settings
from quernstone.sources import client as clients
from quernstone.sources import datasets
from quernstone.sources.shared import checkpointed
from quernstone.sources.store import ParquetStore

NAMES = ["collect", "clean", "analyze", "generate", "verify", "refine", "benchmark", "export"]
SHORT = [n for n in NAMES if n not in ("refine", "benchmark")]
for _f in formats.FIELDS:
    FORMATS.register(_f, formats.Format(_f))
for _t, _v in templates.TEMPLATES.items():
    TEMPLATES.register(_t, _v)


@dataclass
class Context:
    spark: SparkSession
    topic: str
    settings: Settings
    store: ParquetStore
    client: Any
    budget: metrics.Budget
    run_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    info: dict[str, Any] = field(default_factory=dict)

    def ask(self, prompts: DataFrame, stage: str, model: str = "") -> DataFrame:
        """Texts for prompts; each call is charged to the ledger."""
        found = clients.complete_batch(prompts, self.client, clients.resolve_model(model, self.settings.default_model), self.settings.generate.max_concurrent, stage)
        used = found.groupBy("model").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"), F.sum("cost").alias("c")).collect()
        for r in used:
            self.budget.record(r["i"], r["o"], r["model"], r["c"], stage)
        return found


@dataclass
class Result:
    run_id: str
    status: str
    metrics: dict
    samples: DataFrame | None
    output_dir: str


@STAGES.register("collect")
def collect_stage(c: Context) -> None:
    s = c.settings.collect
    found = collect.collect(c.tables["pages"], s.blocked_domains, s.min_content_length, s.min_word_count)
    c.tables["documents"] = found.select(F.col("page_id").alias("doc_id"), "url", "title", F.col("content").alias("text"), "content_hash", "word_count")


@STAGES.register("clean")
def clean_stage(c: Context) -> None:
    c.tables["cleaned"] = clean.clean(c.tables["documents"].select("doc_id", "text"), c.settings.clean)


@STAGES.register("analyze")
def analyze_stage(c: Context) -> None:
    spark, chunks = c.spark, clean.chunk_rows(c.tables["cleaned"])
    prompt = F.concat(F.lit(f"Plan training samples on {c.topic}. Answer with JSON: generation_plan, a list of name, concepts, sample_count, difficulties.\n"), F.col("excerpts"))
    asked = generate.excerpts(chunks).select(F.lit("plan").alias("call_id"), prompt.alias("prompt"), F.lit("You plan datasets.").alias("system"))
    texts = c.ask(asked, "analyze").select(F.lit(c.topic).alias("topic"), F.coalesce("text", F.lit("")).alias("text"))
    c.tables["plan"] = generate.parse_plan(texts if texts.head(1) else spark.createDataFrame([(c.topic, "")], "topic string, text string"))


@STAGES.register("generate")
def generate_stage(c: Context) -> None:
    g = c.settings.generate
    fmt, key = g.default_format, ["plan_pos", "concept_pos", "level_pos"]
    cells = generate.expand(c.tables["plan"], g.max_samples, g.batch_size).where("batch > 0")
    contexts = generate.context_sample(cells, clean.chunk_rows(c.tables["cleaned"]), key)
    prompts = generate.build_prompts(cells, contexts, fmt, key).withColumn("n", F.explode(F.sequence(F.lit(1), "batch")))
    prompts = prompts.withColumn("prompt_id", F.concat_ws("-", F.lit("p"), *key, "n"))
    repeated = prompts.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(max(1, g.self_consistency_n) - 1)))).withColumn("call_id", F.concat_ws("-", "prompt_id", "pos"))
    texts = c.ask(repeated, "generate").where("error IS NULL").select("call_id", "model", "text")
    joined = repeated.select("call_id", "prompt_id", "pos", "concept", "name", "level", "source_ids").join(texts, "call_id")
    made = generate.self_consistent(joined, fmt, c.run_id) if g.self_consistency_n > 1 else generate.to_samples(joined, fmt, c.run_id).where("valid")
    c.tables["samples"] = made


def _verified(c: Context, samples: DataFrame, stage: str) -> DataFrame:
    """``samples`` with verdict, quality_score and issues from the rule critics and the models that the settings name."""
    v = c.settings.verify
    ask = lambda what, model: c.ask(samples.select(F.col("sample_id").alias("call_id"), F.concat(F.lit(f"{what}\n"), F.to_json("content")).alias("prompt"), F.lit("You check training data. Answer with JSON only.").alias("system")), stage, model).select(F.col("call_id").alias("sample_id"), "model", F.coalesce("text", F.lit("")).alias("text"))
    judges = critiques = scores = None
    if len(v.judge_models) >= 2:
        texts = [ask("Judge: verdict, severity, step_failures, confidence, reasoning.", m) for m in v.judge_models]
        both = texts[0]
        for t in texts[1:]:
            both = both.unionByName(t)
        judges = verify.judges_from(both)
    else:
        model = clients.resolve_model(v.critic_model, c.settings.default_model)
        if model:
            critiques = verify.parse_critiques(ask("Critique: issues, severity, reasoning, passed.", model))
            scores = verify.parse_scores(ask("Score: accuracy, relevance, completeness.", clients.resolve_model(v.scorer_model, model)))
    return verify.verify(samples, c.tables["documents"], critiques, scores, judges, v.min_pass_rate, v.min_score)


@STAGES.register("verify")
def verify_stage(c: Context) -> None:
    if c.settings.verify.enabled:
        c.tables["samples"] = _verified(c, c.tables["samples"], "verify")


@STAGES.register("refine")
def refine_stage(c: Context) -> None:
    samples = c.tables["samples"]
    if "verdict" not in samples.columns:
        return
    fresh = [x for x in ("content", "verdict", "quality_score", "issues") if x in samples.columns]
    base = samples.select("sample_id", "format", *fresh, *[x for x in samples.columns if x == "agreement_ratio"])

    def rewrite(rows: DataFrame, attempt: int) -> DataFrame:
        prompt = F.concat(F.lit("Mend the listed issues and keep the structure.\n"), F.to_json("content"), F.lit("\n"), F.array_join("issues", "\n"))
        texts = c.ask(rows.select(F.col("sample_id").alias("call_id"), prompt.alias("prompt"), F.lit("Answer with JSON only.").alias("system")), "refine")
        fresh = texts.select(F.col("call_id").alias("sample_id"), F.try_parse_json(formats.T.strip_fence(F.col("text"))).alias("fresh")).where("fresh IS NOT NULL AND schema_of_variant(fresh) LIKE 'OBJECT%'")
        return rows.join(fresh, "sample_id").withColumn("content", F.col("fresh")).drop("fresh")

    def judge(rows: DataFrame, attempt: int) -> DataFrame:
        rows = checkpointed(rows)  # the models are asked about the very rows that are kept
        if rows.isEmpty():
            return rows
        return _verified(c, rows, "refine").select("sample_id", "verdict", "quality_score", "issues")

    settled = refine.refine(base, rewrite, judge, c.settings.refine.max_retries)
    c.tables["samples"] = samples.drop(*fresh).join(settled.select("sample_id", *fresh, "attempt"), "sample_id")


@STAGES.register("benchmark")
def benchmark_stage(c: Context) -> None:
    samples = c.tables["samples"]
    if "verdict" in samples.columns and not samples.isEmpty():
        c.info["benchmark"] = metrics.benchmark(samples).first().asDict()
        c.info["failure_reasons"] = {r["reason"]: r["samples"] for r in metrics.failure_reasons(samples).collect()}
        c.store.save("benchmarks", c.spark.createDataFrame([(c.run_id, json.dumps(c.info["benchmark"]))], "doc_id string, data string"))


@STAGES.register("export")
def export_stage(c: Context) -> None:
    samples = c.tables["samples"]
    c.info["exported"] = datasets.export(samples if "verdict" in samples.columns else samples.withColumn("verdict", F.lit(None).cast("string")), c.topic, c.settings.output_dir, c.run_id)


class Pipeline:
    """``stages`` defaults to all eight; ``SHORT`` leaves refinement and benchmark out."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, client: Any = None, stages: list[str] | None = None, hooks: Hooks | None = None):
        self.spark, self.settings, self.client = spark, settings or Settings(), client or clients.Echo(lambda p: "")
        self.stages: list[tuple[str, Callable[[Context], None]]] = [(n, STAGES.get(n)) for n in (stages or NAMES)]
        self.hooks, self.collector = hooks or Hooks(), metrics.Collector()
        #: Which stages run only where this says so; collecting is left out where documents are given.
        self.when: dict[str, Callable[[Context], bool]] = {"collect": lambda c: "pages" in c.tables}

    def add_stage(self, name: str, stage: Callable[[Context], None], before: str | None = None, when: Callable[[Context], bool] | None = None) -> None:
        at = next((k for k, (n, _) in enumerate(self.stages) if n == before), len(self.stages))
        self.stages.insert(at, (name, stage))
        if when is not None:
            self.when[name] = when

    def _context(self, topic: str, run_id: str) -> Context:
        s = self.settings
        return Context(self.spark, topic, s, ParquetStore(self.spark, f"{s.output_dir}/store"), self.client, metrics.Budget(s.budget.max_cost_usd, s.budget.warn_at_percent / 100), run_id)

    def _checkpoint(self, c: Context, name: str) -> None:
        at = f"{self.settings.output_dir}/runs/{c.run_id}/{name}"
        for k in list(c.tables):
            if k != "pages":
                c.tables[k].write.mode("overwrite").parquet(f"{at}/{k}")
                c.tables[k] = self.spark.read.parquet(f"{at}/{k}")
        c.store.save_state(c.run_id, json.dumps({"stage": name, "tables": [k for k in c.tables if k != "pages"], "spent": c.budget.spent}))

    def _resumed(self, c: Context) -> str | None:
        state = c.store.load_state(c.run_id)
        if state is None:
            return None
        known = json.loads(state)
        for k in known["tables"]:
            c.tables[k] = self.spark.read.parquet(f"{self.settings.output_dir}/runs/{c.run_id}/{known['stage']}/{k}")
        c.budget.spent = known["spent"]
        return known["stage"]

    def run(self, topic: str, run_id: str | None = None, resume: bool = False, **tables: DataFrame) -> Result:
        """Raises what a stage raises, BudgetExceeded and GateFailed. ``tables``: at least pages, or documents without the collect stage."""
        c = self._context(topic, run_id or uuid.uuid4().hex)
        c.tables.update(tables)
        done = self._resumed(c) if resume else None
        left = self.stages[[n for n, _ in self.stages].index(done) + 1 :] if done else self.stages
        self.hooks.emit(Event.PIPELINE_START, topic=topic, run_id=c.run_id)
        try:
            for name, stage in left:
                if not self.when.get(name, lambda _: True)(c):
                    continue
                self.hooks.emit(Event.STAGE_START, stage=name)
                with self.collector.timer(name):
                    stage(c)
                    self._checkpoint(c, name)
                self.hooks.emit(Event.STAGE_END, stage=name)
                if c.budget.warning:
                    self.hooks.emit(Event.BUDGET_WARNING, spent=c.budget.spent, limit=c.budget.limit)
        except Exception as e:
            self.hooks.emit(Event.ERROR, error=e, status="budget_exceeded" if isinstance(e, metrics.BudgetExceeded) else "failed")
            raise
        found = self._metrics(c)
        g = self.settings.quality_gates
        limits = metrics.Limits(g.max_duplicate_rate, g.min_diversity_score, g.min_verification_score, self.settings.budget.max_cost_usd)
        row = self.spark.createDataFrame([(found["documents"], found["duplicates"], found["diversity"], found["pass_rate"], c.budget.spent)], "total long, duplicates long, diversity double, pass_rate double, cost double")
        failed = [r.asDict() for r in metrics.failed_gates(row, limits).collect()]
        if failed:
            raise metrics.GateFailed(failed)
        self.hooks.emit(Event.PIPELINE_END, run_id=c.run_id)
        return Result(c.run_id, "completed", found | c.info, c.tables.get("samples"), self.settings.output_dir)

    def _metrics(self, c: Context) -> dict:
        docs, samples = c.tables.get("documents"), c.tables.get("samples")
        out = {"documents": 0, "duplicates": 0, "diversity": 0.0, "pass_rate": 0.0, "samples": 0, "cost": c.budget.spent, "seconds": dict(self.collector.seconds)}
        if docs is not None:
            r = dedup.report(dedup.greedy(docs)).first()
            out |= {"documents": r["total"], "duplicates": r["exact_duplicates"] + r["near_duplicates"]}
        if samples is not None and not samples.isEmpty():
            question = F.coalesce(*[F.try_variant_get("content", f"$.{k}", "string") for k in ("question", "issue")])
            score = metrics.diversity(samples.select("subtopic", "difficulty", question.alias("question"))).first()
            out |= {"samples": samples.count(), "diversity": score["overall"]}
            if "verdict" in samples.columns:
                out["pass_rate"] = metrics.benchmark(samples).first()["pass_rate"]
        return out

    def run_stage(self, name: str, topic: str, **tables: DataFrame) -> Context:
        """One stage alone on the given tables; a name that isn't there is a ValueError."""
        stage = dict(self.stages).get(name)
        if stage is None:
            raise ValueError(f"no stage '{name}' in {[n for n, _ in self.stages]}")
        c = self._context(topic, uuid.uuid4().hex)
        c.tables.update(tables)
        stage(c)
        return c

    def dry_run(self, template: str | None = None) -> dict:
        rows = templates.as_table(self.spark)
        g, s = self.settings.generate, self.settings.collect
        if template is None:
            rows = self.spark.createDataFrame([("settings", s.max_pages, g.max_samples)], "template string, pages long, samples long")
        else:
            rows = rows.where(F.col("template") == template)
        return templates.dry_run(rows, s.max_documents).first().asDict()
