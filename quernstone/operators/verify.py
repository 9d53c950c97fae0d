"""Verification: rule critics, weighted scores, consensus, judge ensembles.

Samples are rows with ``sample_id``, ``format`` and ``content`` (variant). Critiques, scores and judge verdicts are long
tables by sample; each is grouped by sample before it is joined, so a sample's rows meet once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.formats import FIELDS

#: Principles is the format that the rule otherwise measures by reasoning's keys.
FORMAT_KEYS = {k: v for k, v in FIELDS.items() if k != "principles"}
PRINCIPLES_KEYS = FIELDS["principles"]
MIN_OVERLAP, MIN_PASS_RATE, MIN_SCORE, MIN_AGREEMENT, MIN_ANSWER = 0.3, 0.6, 0.7, 0.34, 20
ANSWER_KEYS = ["answer", "result", "analysis"]
WEIGHTS = {"accuracy": 0.4, "relevance": 0.3, "completeness": 0.3}


def keys_of(content: Column) -> Column:
    return F.json_object_keys(F.to_json(content))


def format_critiques(samples: DataFrame, principles: bool = True) -> DataFrame:
    """(sample_id, critic_model, issues, severity, passed): required keys that a record lacks.

    ``principles=False`` judges that format by reasoning's keys, as unknown formats are.
    """
    known = FORMAT_KEYS | ({"principles": PRINCIPLES_KEYS} if principles else {})
    fmt = F.when(F.coalesce("format", F.lit("")) == "", "reasoning").otherwise(F.col("format"))
    listed = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    named = samples.withColumn("__fmt", fmt).withColumn("__required", F.coalesce(listed[F.col("__fmt")], F.array(*map(F.lit, known["reasoning"]))))
    missing = named.withColumn("__missing", F.array_except("__required", F.coalesce(keys_of(F.col("content")), F.array().cast("array<string>"))))
    n, m = F.size("__required"), F.size("__missing")
    issues = F.transform("__missing", lambda k: F.concat(F.lit("missing key '"), k, F.lit("' of format '"), F.col("__fmt"), F.lit("'")))
    severity = F.when(m == 0, "none").when(m > F.floor(n / 2), "fatal").otherwise("major")
    return missing.select("sample_id", F.lit("format_check").alias("critic_model"), issues.alias("issues"), severity.alias("severity"), (m == 0).alias("passed"))


def answer_text(content: Column) -> Column:
    """The record's answer fields that are strings, each after a blank."""
    def of(key: str) -> Column:
        v = F.variant_get(content, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit(" "), F.variant_get(v, "$", "string"))).otherwise("")

    return F.concat(*[F.coalesce(of(k), F.lit("")) for k in ANSWER_KEYS])


def word_overlap(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(sample_id, words, found): the words of ``answer`` and how many of them occur in any text of ``sources``.

    Both sides are reduced to distinct words before they meet: the vocabulary, which grows far slower than the corpus, is
    joined by word, and a word that many samples use is shuffled once for each sample.
    """
    tokens = lambda c: F.explode(T.words(F.lower(F.col(c))))
    vocabulary = sources.select(tokens("text").alias("word")).distinct().withColumn("known", F.lit(1))
    used = answers.select("sample_id", tokens("answer").alias("word")).groupBy("sample_id", "word").agg(F.count("*").alias("n"))
    return used.join(vocabulary, "word", "left").groupBy("sample_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("found"))


def factual_critiques(samples: DataFrame, sources: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(sample_id, critic_model, issues, severity, passed): answers too few of whose words occur in the sources, or none at all."""
    answers = samples.select("sample_id", answer_text(F.col("content")).alias("answer"))
    judged = answers.select("sample_id").join(word_overlap(answers, sources), "sample_id", "left")
    low = F.col("found") / F.col("words") < min_overlap
    issue = F.when(F.col("words").isNull(), "no answer text").when(low, F.concat(F.lit("low factual grounding: "), F.format_string("%.0f%%", 100 * F.col("found") / F.col("words")), F.lit(" word overlap")))
    issues = F.when(issue.isNull(), F.array().cast("array<string>")).otherwise(F.array(issue))
    return judged.select("sample_id", F.lit("factual_overlap").alias("critic_model"), issues.alias("issues"), F.when(issue.isNull(), "none").otherwise("major").alias("severity"), issue.isNull().alias("passed"))


_CRITIQUE = "issues array<string>, severity string, reasoning string, passed boolean"


def parse_critiques(responses: DataFrame) -> DataFrame:
    """(sample_id, critic_model, issues, severity, reasoning, passed) from raw model texts (sample_id, model, text)."""
    found = responses.withColumn("__r", F.from_json(T.strip_fence(F.col("text")), _CRITIQUE))
    ok = F.try_parse_json(T.strip_fence(F.col("text"))).isNotNull()
    return found.select(
        "sample_id", F.col("model").alias("critic_model"),
        F.when(ok, F.coalesce("__r.issues", F.array().cast("array<string>"))).otherwise(F.array(F.lit("critic failed"))).alias("issues"),
        F.when(ok, F.coalesce("__r.severity", F.lit("none"))).otherwise("major").alias("severity"),
        F.coalesce("__r.reasoning", F.lit("")).alias("reasoning"), F.when(ok, F.coalesce("__r.passed", F.lit(True))).otherwise(False).alias("passed"),
    )


def overall_score(accuracy: Column, relevance: Column, completeness: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum, missing scores counting as 0, rounded to 4 places."""
    part = lambda x: F.coalesce(x, F.lit(0.0))
    return F.round(part(accuracy) * weights["accuracy"] + part(relevance) * weights["relevance"] + part(completeness) * weights["completeness"], 4)


def parse_scores(responses: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(sample_id, scorer_model, accuracy, relevance, completeness, overall) from raw model texts; unreadable ones score 0."""
    r = responses.withColumn("__r", F.from_json(T.strip_fence(F.col("text")), "accuracy double, relevance double, completeness double"))
    parts = [F.coalesce(f"__r.{k}", F.lit(0.0)) for k in weights]
    return r.select("sample_id", F.col("model").alias("scorer_model"), *[p.alias(k) for p, k in zip(parts, weights)], overall_score(*parts, weights).alias("overall"))


def grouped_critiques(critiques: DataFrame) -> DataFrame:
    """(sample_id, pass_rate, fatal)."""
    return critiques.groupBy("sample_id").agg(F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.bool_or(F.col("severity") == "fatal").alias("fatal"))


def consensus(samples: DataFrame, critiques: DataFrame, scores: DataFrame, min_pass_rate: float = MIN_PASS_RATE, min_score: float = MIN_SCORE) -> DataFrame:
    """(sample_id, verdict, confidence, pass_rate, avg_score): a fatal critique rejects; both rates at their least accept; else revise."""
    rated = samples.select("sample_id").join(grouped_critiques(critiques), "sample_id", "left").join(scores.groupBy("sample_id").agg(F.avg("overall").alias("avg_score")), "sample_id", "left")
    rate, score = F.coalesce("pass_rate", F.lit(1.0)), F.coalesce("avg_score", F.lit(0.0))
    verdict = F.when(F.coalesce("fatal", F.lit(False)), "reject").when((rate >= min_pass_rate) & (score >= min_score), "accept").otherwise("revise")
    return rated.select("sample_id", verdict.alias("verdict"), F.round(rate * score, 4).alias("confidence"), rate.alias("pass_rate"), score.alias("avg_score"))


def merge_judges(judges: DataFrame) -> DataFrame:
    """(sample_id, verdict, confidence, issues): any fatal rejects with confidence 0; else unanimity accepts, one reject rejects, the rest revises."""
    issue = F.when(F.col("verdict") != "accept", F.struct("judge_model", F.concat(F.lit("["), "judge_model", F.lit("] "), F.coalesce("reasoning", F.lit(""))).alias("issue")))
    g = judges.groupBy("sample_id").agg(
        F.bool_or(F.col("severity") == "fatal").alias("fatal"), F.bool_and(F.col("verdict") == "accept").alias("all_accept"),
        F.bool_or(F.col("verdict") == "reject").alias("any_reject"), F.min("confidence").alias("least"), F.array_sort(F.collect_list(issue)).alias("found"),
    )
    verdict = F.when(F.col("fatal"), "reject").when(F.col("all_accept"), "accept").when(F.col("any_reject"), "reject").otherwise("revise")
    return g.select("sample_id", verdict.alias("verdict"), F.when(F.col("fatal"), 0.0).otherwise(F.col("least")).alias("confidence"), F.transform("found", lambda x: x["issue"]).alias("issues"))


def judges_from(responses: DataFrame, min_models: int = 2) -> DataFrame:
    """(sample_id, judge_model, verdict, severity, step_failures, confidence, reasoning) from raw texts (sample_id, model, text).

    A judge that can't be read revises with confidence 0. An ensemble of fewer than two models is an error.
    """
    if responses.select("model").distinct().limit(min_models).count() < min_models:
        raise ValueError(f"a judge ensemble needs at least {min_models} models")
    r = responses.withColumn("__r", F.from_json(T.strip_fence(F.col("text")), "verdict string, severity string, step_failures array<int>, confidence double, reasoning string"))
    c = lambda k, d: F.coalesce(f"__r.{k}", d)
    return r.select("sample_id", F.col("model").alias("judge_model"), c("verdict", F.lit("revise")).alias("verdict"), c("severity", F.lit("none")).alias("severity"), c("step_failures", F.array().cast("array<int>")).alias("step_failures"), c("confidence", F.lit(0.0)).alias("confidence"), c("reasoning", F.lit("")).alias("reasoning"))


def consensus_with_judges(samples: DataFrame, critiques: DataFrame, judges: DataFrame, min_pass_rate: float = MIN_PASS_RATE, min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """(sample_id, verdict, confidence); ``samples`` may have ``agreement_ratio`` (1 where null)."""
    merged = merge_judges(judges).select("sample_id", F.col("verdict").alias("judged"), F.col("confidence").alias("sure"))
    base = samples.select("sample_id", F.coalesce("agreement_ratio", F.lit(1.0)).alias("agreement"))
    j = base.join(grouped_critiques(critiques), "sample_id", "left").join(merged, "sample_id", "left")
    verdict = (
        F.when(F.coalesce("fatal", F.lit(False)) | (F.col("judged") == "reject"), "reject")
        .when((F.col("judged") == "accept") & (F.col("agreement") >= min_agreement) & (F.coalesce("pass_rate", F.lit(1.0)) >= min_pass_rate), "accept")
        .otherwise("revise")
    )
    return j.select("sample_id", verdict.alias("verdict"), F.round(F.least(F.coalesce("sure", F.lit(0.0)), "agreement"), 4).alias("confidence"))


def verify(samples: DataFrame, sources: DataFrame, critiques: DataFrame | None = None, scores: DataFrame | None = None, judges: DataFrame | None = None, min_pass_rate: float = MIN_PASS_RATE, min_score: float = MIN_SCORE) -> DataFrame:
    """``samples`` with verdict, quality_score and issues. Rule critics always run; model critiques, scores and judges are tables.

    With judges the ensemble decides, else critiques and scores do.
    """
    columns = ["sample_id", "critic_model", "issues", "severity", "passed"]
    found = format_critiques(samples).unionByName(factual_critiques(samples, sources))
    if critiques is not None and judges is None:
        found = found.unionByName(critiques.select(*columns))
    if judges is not None:
        agreed = samples if "agreement_ratio" in samples.columns else samples.withColumn("agreement_ratio", F.lit(1.0))
        decided = consensus_with_judges(agreed, found, judges, min_pass_rate)
        found = found.select("sample_id", "issues").unionByName(merge_judges(judges).select("sample_id", "issues"))
    else:
        empty = samples.select("sample_id", F.lit(0.0).alias("overall")).limit(0)
        decided = consensus(samples, found, scores if scores is not None else empty, min_pass_rate, min_score)
    issues = found.groupBy("sample_id").agg(F.array_sort(F.flatten(F.collect_list("issues"))).alias("issues"))
    out = samples.drop("verdict", "quality_score", "issues")
    return out.join(decided.select("sample_id", "verdict", F.col("confidence").alias("quality_score")), "sample_id").join(issues, "sample_id", "left")


def counters(verified: DataFrame) -> DataFrame:
    """(verdict, samples)."""
    return verified.groupBy("verdict").agg(F.count("*").alias("samples"))


def accepted(samples: DataFrame) -> DataFrame:
    """Samples that aren't rejected; those without a verdict and those to revise stay."""
    return samples.where(F.coalesce("verdict", F.lit("")) != "reject")


def to_revise(samples: DataFrame) -> DataFrame:
    return samples.where("verdict = 'revise'")


def sample_issues(samples: DataFrame, required: list[str]) -> DataFrame:
    """(sample_id, passed, issues): missing keys, blank strings, short answers, missing lineage (``lineage``, else the record itself)."""
    content = F.col("content")
    present = F.coalesce(keys_of(content), F.array().cast("array<string>"))
    text = lambda k: F.try_variant_get(content, f"$.{k}", "string")
    is_text = lambda k: F.schema_of_variant(F.variant_get(content, f"$.{k}", "variant")) == "STRING"
    pairs = F.from_json(F.to_json(content), "map<string,string>")
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), present), lambda k: F.concat(F.lit("missing key: "), k))
    blank = F.transform(F.filter(F.map_entries(pairs), lambda e: T.strip(e["value"]) == ""), lambda e: F.concat(F.lit("key '"), e["key"], F.lit("' is blank")))
    short = [F.when(is_text(k) & F.length(T.strip(text(k))).between(1, MIN_ANSWER - 1), F.concat(F.lit(f"key '{k}' is too short ("), F.length(T.strip(text(k))).cast("string"), F.lit(")"))) for k in ANSWER_KEYS]
    line = F.coalesce(F.variant_get(content, "$.lineage", "variant"), content)
    full = lambda k: ~F.coalesce(F.try_variant_get(line, f"$.{k}", "string"), F.lit("")).isin("", "[]", "{}", "0", "false")
    lineage = F.when(full("sample_id") & full("source_documents") & full("generation_model"), F.array().cast("array<string>")).otherwise(F.array(F.lit("lineage is incomplete")))
    none = F.array().cast("array<string>")
    issues = F.concat(missing, F.coalesce(blank, none), F.filter(F.array(*short), lambda x: x.isNotNull()), lineage)
    return samples.select("sample_id", issues.alias("issues")).select("sample_id", (F.size("issues") == 0).alias("passed"), "issues")
