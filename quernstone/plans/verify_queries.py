"""Queries of self-consistency, critics, consensus and refinement over relations derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import consistency as C
from quernstone.operators import refine as R
from quernstone.operators import verify as V
from quernstone.plans import text_sql as Q
from quernstone.plans.registry import query, table

# ---- candidates: a conversation is a prompt, its turns are candidates, the answer is a turn's whole text ----

_ANSWER = rf"regexp_replace(regexp_replace(lower({Q.strip('text')}), '\s+', ' ', 'g'), '^[ .!?]+|[ .!?]+$', '', 'g')"
CANDIDATES = f"""cand AS MATERIALIZED (SELECT conv_id AS prompt_id, turn AS pos, conv_id || '-' || turn AS candidate_id, {_ANSWER} AS answer_signature,
  CASE (conv_id + turn) % 5 WHEN 0 THEN false WHEN 1 THEN true END AS programmatic_pass FROM conversations),
alive AS (SELECT * FROM cand WHERE programmatic_pass IS DISTINCT FROM false),
clus AS MATERIALIZED (SELECT prompt_id, answer_signature, count(*) AS size, min(pos) AS first_pos FROM alive GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY prompt_id ORDER BY size DESC, first_pos) - 1)::INTEGER AS cluster_id FROM clus)"""


def candidates(spark, sf_dir):
    answer = C.answer_signature(F.to_variant_object(F.struct(F.col("text").alias("answer"))), F.lit("reasoning"))
    k = (F.col("conv_id") + F.col("turn")) % 5
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("prompt_id"), F.col("turn").alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("candidate_id"),
        answer.alias("answer_signature"), F.when(k == 0, False).when(k == 1, True).alias("programmatic_pass"),
    )


@query(f"WITH {CANDIDATES} SELECT prompt_id, answer_signature, cluster_id, size, first_pos FROM ranked")
def self_consistency_clusters(spark, sf_dir):
    return C.clusters(candidates(spark, sf_dir))


@query(f"""WITH {CANDIDATES},
n AS (SELECT prompt_id, count(*) FILTER (WHERE programmatic_pass IS DISTINCT FROM false) AS n FROM cand GROUP BY 1),
best AS (SELECT a.prompt_id, a.candidate_id, row_number() OVER (PARTITION BY a.prompt_id ORDER BY coalesce(NOT a.programmatic_pass, true), a.pos) AS k
  FROM alive a JOIN ranked r ON r.prompt_id = a.prompt_id AND r.answer_signature = a.answer_signature AND r.cluster_id = 0),
top AS (SELECT n.prompt_id, n.n, coalesce(r.size, 0) AS size, CASE WHEN n.n = 1 OR r.size >= 2 THEN b.candidate_id END AS selected_id
  FROM n LEFT JOIN ranked r ON r.prompt_id = n.prompt_id AND r.cluster_id = 0 LEFT JOIN best b ON b.prompt_id = n.prompt_id AND b.k = 1)
SELECT prompt_id, selected_id, CASE WHEN n > 0 THEN size::DOUBLE / n ELSE 0 END AS agreement_ratio,
  CASE WHEN n > 1 THEN (SELECT string_agg(a.candidate_id, ',' ORDER BY a.pos) FROM alive a WHERE a.prompt_id = top.prompt_id AND a.candidate_id IS DISTINCT FROM top.selected_id) ELSE '' END AS rejected FROM top""")
def self_consistency_winner(spark, sf_dir):
    return C.winners(candidates(spark, sf_dir)).select("prompt_id", "selected_id", "agreement_ratio", F.array_join("rejected_ids", ",").alias("rejected"))


# ---- records: one JSON object for each turn; keys are left out by conv_id % 7 ----

RECORDS = """rec AS (SELECT conv_id * 100 + turn AS sample_id, conv_id, turn, text,
  conv_id % 7 <> 1 AND conv_id % 7 <> 4 AS q, conv_id % 7 <> 2 AND conv_id % 7 <> 4 AS a, conv_id % 7 <> 4 AS r, conv_id % 7 <> 3 AS m FROM conversations)"""


def record_json():
    k = F.col("conv_id") % 7
    part = lambda name, keep, value: F.when(keep, F.concat(F.lit(f'"{name}": '), value))
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.regexp_extract(text, r"(?s)^\{\"t\":(.*)\}$", 1)
    parts = [part("question", ~k.isin(1, 4), quoted), part("analysis", ~k.isin(2, 4), quoted), part("answer", k != 4, quoted), part("metadata", k != 3, F.lit('{"difficulty": "easy"}'))]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def samples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("record", record_json())
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), F.lit("reasoning").alias("format"), F.parse_json("record").alias("content"), "text", "conv_id", "turn")


@query(f"""WITH {RECORDS} SELECT sample_id, (4 - q::INTEGER - a::INTEGER - r::INTEGER - m::INTEGER) AS missing,
CASE 4 - q::INTEGER - a::INTEGER - r::INTEGER - m::INTEGER WHEN 0 THEN 'none' WHEN 1 THEN 'major' WHEN 2 THEN 'major' ELSE 'fatal' END AS severity, q AND a AND r AND m AS passed FROM rec""")
def format_critic(spark, sf_dir):
    return V.format_critiques(samples(spark, sf_dir)).select("sample_id", F.size("issues").alias("missing"), "severity", "passed")


@query(f"""WITH {RECORDS}, vocabulary AS (SELECT DISTINCT unnest({Q.words('lower(text)')}) AS w FROM documents),
ans AS (SELECT sample_id, coalesce(CASE WHEN r THEN ' ' || text END, '') || coalesce(CASE WHEN a THEN ' ' || text END, '') AS t FROM rec),
tok AS (SELECT sample_id, unnest({Q.words('lower(t)')}) AS w FROM ans),
hit AS (SELECT sample_id, count(*) AS words, count(v.w) AS found FROM tok LEFT JOIN vocabulary v USING (w) GROUP BY 1)
SELECT sample_id, words, found, CASE WHEN words IS NULL OR found::DOUBLE / words < 0.3::DOUBLE THEN 'major' ELSE 'none' END AS severity FROM ans LEFT JOIN hit USING (sample_id)""")
def factual_overlap(spark, sf_dir):
    s = samples(spark, sf_dir)
    sources = table(spark, sf_dir, "documents")
    counts = V.word_overlap(s.select("sample_id", V.answer_text(F.col("content")).alias("answer")), sources)
    return V.factual_critiques(s, sources).select("sample_id", "severity").join(counts, "sample_id", "left")


# ---- verification as a whole: rule critics, a model critic and a scorer for each turn ----


def turn_critiques(spark, sf_dir):
    fatal, minor = F.col("conv_id") % 11 == 0, F.col("turn") % 3 == 0
    severity = F.when(fatal, "fatal").when(minor, "minor").otherwise("none")
    issues = F.when(severity == "none", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("model says "), severity)))
    return samples(spark, sf_dir).select("sample_id", F.lit("m").alias("critic_model"), issues.alias("issues"), severity.alias("severity"), (~minor).alias("passed"))


@query(f"""WITH {RECORDS}, vocabulary AS (SELECT DISTINCT unnest({Q.words('lower(text)')}) AS w FROM documents),
ans AS (SELECT sample_id, coalesce(CASE WHEN r THEN ' ' || text END, '') || coalesce(CASE WHEN a THEN ' ' || text END, '') AS t FROM rec),
tok AS (SELECT sample_id, unnest({Q.words('lower(t)')}) AS w FROM ans),
hit AS (SELECT sample_id, count(*) AS words, count(v.w) AS found FROM tok LEFT JOIN vocabulary v USING (w) GROUP BY 1),
each AS (SELECT rec.sample_id, 4 - q::INTEGER - a::INTEGER - r::INTEGER - m::INTEGER AS missing, words IS NOT NULL AND found::DOUBLE / words >= 0.3::DOUBLE AS grounded,
  conv_id % 11 = 0 AS bad, turn % 3 = 0 AS odd, round((conv_id % 11) / 10.0::DOUBLE * 0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE, 4) AS score FROM rec LEFT JOIN hit USING (sample_id)),
rated AS (SELECT *, ((missing = 0)::INTEGER + grounded::INTEGER + (NOT odd)::INTEGER) / 3.0::DOUBLE AS rate FROM each)
SELECT sample_id, CASE WHEN missing > 2 OR bad THEN 'reject' WHEN rate >= 0.6::DOUBLE AND score >= 0.7::DOUBLE THEN 'accept' ELSE 'revise' END AS verdict,
round(rate * score, 4) AS quality_score, missing + (NOT grounded)::INTEGER + (bad OR odd)::INTEGER AS issues FROM rated""")
def verify_samples(spark, sf_dir):
    s = samples(spark, sf_dir)
    score = s.select("sample_id", V.overall_score(F.col("conv_id") % 11 / 10, F.lit(1.0), F.lit(1.0)).alias("overall"))
    found = V.verify(s, table(spark, sf_dir, "documents"), turn_critiques(spark, sf_dir), score)
    return found.select("sample_id", "verdict", "quality_score", F.size("issues").alias("issues"))


# ---- answers of each format by signature ----


@query(f"""SELECT conv_id * 100 + turn AS sample_id, ['reasoning', 'agent', 'coding', 'chat', 'instruction', 'principles'][turn % 6 + 1] AS format,
regexp_replace(regexp_replace(lower({Q.strip("raw")}), '\\s+', ' ', 'g'), '^[ .!?]+|[ .!?]+$', '', 'g') AS signature
FROM (SELECT *, CASE turn % 6 WHEN 1 THEN 'r: ' || text WHEN 2 THEN 'p: ' || text WHEN 3 THEN 'c1 ' || text WHEN 4 THEN 'm1 ' || text ELSE text END AS raw FROM conversations)""")
def answer_signatures(spark, sf_dir):
    text = F.col("text")
    with_ = lambda head: F.concat(F.lit(head), text)
    content = F.struct(text.alias("answer"), with_("r: ").alias("result"), with_("p: ").alias("patch"), F.array(F.lit("c1"), text).alias("conversations"), F.array(F.lit("m1"), text).alias("messages"))
    fmt = F.element_at(F.array(*map(F.lit, ("reasoning", "agent", "coding", "chat", "instruction", "principles"))), F.col("turn").cast("int") % 6 + 1)
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), fmt.alias("format"), C.answer_signature(F.to_variant_object(content), fmt).alias("signature"))


# ---- texts of model critics, scorers and judges: bare JSON, fenced JSON and none, by doc_id % 3 ----


def model_texts(rows, record):
    body, k = F.to_json(record), F.col("sample_id") % 3
    return rows.withColumn("text", F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("no json here"))


@query("""SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 = 2 THEN 'critic failed' WHEN quality = 1 THEN '' ELSE 'weak;short' END AS issues,
CASE WHEN doc_id % 3 = 2 THEN 'major' WHEN toxic = 1 THEN 'fatal' ELSE 'none' END AS severity, doc_id % 3 <> 2 AND quality = 1 AS passed FROM labels""")
def critic_texts(spark, sf_dir):
    good = F.col("quality") == 1
    record = F.struct(F.when(~good, F.array(F.lit("weak"), F.lit("short"))).alias("issues"), F.when(F.col("toxic") == 1, "fatal").alias("severity"), good.alias("passed"))
    found = V.parse_critiques(model_texts(labelled(spark, sf_dir), record).select("sample_id", F.lit("m").alias("model"), "text"))
    return found.select("sample_id", F.array_join("issues", ";").alias("issues"), "severity", "passed")


@query("""SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE (doc_id % 11) / 10.0::DOUBLE END AS accuracy, CASE WHEN doc_id % 3 = 2 OR toxic = 1 THEN 0 ELSE 0.5::DOUBLE END AS completeness,
CASE WHEN doc_id % 3 = 2 THEN 0 ELSE round((doc_id % 11) / 10.0::DOUBLE * 0.4::DOUBLE + 1::DOUBLE * 0.3::DOUBLE + CASE WHEN toxic = 1 THEN 0 ELSE 0.5::DOUBLE END * 0.3::DOUBLE, 4) END AS overall FROM labels""")
def scorer_texts(spark, sf_dir):
    record = F.struct((F.col("sample_id") % 11 / 10).alias("accuracy"), F.lit(1.0).alias("relevance"), F.when(F.col("toxic") == 0, 0.5).alias("completeness"))
    found = V.parse_scores(model_texts(labelled(spark, sf_dir), record).select("sample_id", F.lit("m").alias("model"), "text"))
    return found.select("sample_id", "accuracy", "completeness", "overall")


@query("""WITH j AS (SELECT doc_id AS sample_id, 'j' || k AS judge_model, doc_id % 3 = 2 AS none, quality, toxic, k FROM labels, (SELECT unnest([0, 1]) AS k))
SELECT sample_id, judge_model, CASE WHEN none THEN 'revise' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS verdict, CASE WHEN NOT none AND toxic = 1 AND k = 1 THEN 'fatal' ELSE 'none' END AS severity,
CASE WHEN none THEN 0 ELSE (sample_id % 100) / 100.0::DOUBLE END AS confidence FROM j""")
def judge_texts(spark, sf_dir):
    k = F.col("k")
    record = F.struct(F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"), F.when((F.col("toxic") == 1) & (k == 1), "fatal").alias("severity"), (F.col("sample_id") % 100 / 100).alias("confidence"))
    rows = labelled(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    found = V.judges_from(model_texts(rows, record).select("sample_id", F.concat(F.lit("j"), k).alias("model"), "text"))
    return found.select("sample_id", "judge_model", "verdict", "severity", "confidence")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 7 = (doc_id + 1) % 7 OR doc_id % 2 = 0 END AS passed FROM documents""")
def math_answers(spark, sf_dir):
    """Fractions and decimals: half the answers are right, a quarter isn't a number."""
    k = F.col("doc_id")
    answer = F.concat(F.lit("The answer is "), F.when(k % 2 == 0, F.concat(k, F.lit("/2."))).otherwise(F.concat(k + 1, F.lit(" or so"))))
    right = F.when(k % 4 == 3, "unknown").otherwise(F.when(k % 2 == 0, (k / 2).cast("string")).otherwise(k.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", C.math_pass(answer, right).alias("passed"))


# ---- critiques, scores and judges derived from labels ----

CRITIQUES = """crit AS (SELECT doc_id AS sample_id, 'm' || k AS critic_model, CASE WHEN toxic = 1 AND k = 0 THEN 'fatal' WHEN quality = 1 THEN 'none' ELSE 'minor' END AS severity, quality = 1 OR k = 1 AS passed
  FROM labels, (SELECT unnest([0, 1]) AS k)),
sc AS (SELECT doc_id AS sample_id, round((doc_id % 11) / 10.0::DOUBLE * 0.4::DOUBLE + (doc_id % 7) / 6.0::DOUBLE * 0.3::DOUBLE + (doc_id % 13) / 12.0::DOUBLE * 0.3::DOUBLE, 4) AS overall FROM labels),
judge AS (SELECT doc_id AS sample_id, 'j' || k AS judge_model, CASE WHEN toxic = 1 AND k = 1 THEN 'fatal' ELSE 'none' END AS severity, CASE WHEN quality = 1 THEN 'accept' WHEN (doc_id + k) % 3 = 0 THEN 'reject' ELSE 'revise' END AS verdict, ((doc_id + 31 * k) % 100) / 100.0::DOUBLE AS confidence
  FROM labels, (SELECT unnest([0, 1]) AS k)),
gc AS (SELECT sample_id, avg(passed::INTEGER) AS rate, bool_or(severity = 'fatal') AS fatal FROM crit GROUP BY 1),
gs AS (SELECT sample_id, avg(overall) AS score FROM sc GROUP BY 1),
gj AS (SELECT sample_id, CASE WHEN bool_or(severity = 'fatal') THEN 'reject' WHEN bool_and(verdict = 'accept') THEN 'accept' WHEN bool_or(verdict = 'reject') THEN 'reject' ELSE 'revise' END AS verdict,
  CASE WHEN bool_or(severity = 'fatal') THEN 0::DOUBLE ELSE min(confidence) END AS confidence FROM judge GROUP BY 1)"""


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "sample_id")


def critiques(spark, sf_dir):
    k = F.col("k")
    rows = labelled(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    severity = F.when((F.col("toxic") == 1) & (k == 0), "fatal").when(F.col("quality") == 1, "none").otherwise("minor")
    issues = F.when(severity == "none", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("issue "), severity)))
    return rows.select("sample_id", F.concat(F.lit("m"), k).alias("critic_model"), issues.alias("issues"), severity.alias("severity"), ((F.col("quality") == 1) | (k == 1)).alias("passed"))


def scores(spark, sf_dir):
    s = F.col("sample_id")
    return labelled(spark, sf_dir).select("sample_id", (s % 11 / 10).alias("accuracy"), (s % 7 / 6).alias("relevance"), (s % 13 / 12).alias("completeness")).withColumn("overall", V.overall_score(F.col("accuracy"), F.col("relevance"), F.col("completeness")))


def judges(spark, sf_dir):
    s, k = F.col("sample_id"), F.col("k")
    rows = labelled(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    verdict = F.when(F.col("quality") == 1, "accept").when((s + k) % 3 == 0, "reject").otherwise("revise")
    return rows.select("sample_id", F.concat(F.lit("j"), k).alias("judge_model"), F.when((F.col("toxic") == 1) & (k == 1), "fatal").otherwise("none").alias("severity"), verdict.alias("verdict"), ((s + 31 * k) % 100 / 100).alias("confidence"), F.lit("").alias("reasoning"))


@query(f"WITH {CRITIQUES} SELECT sample_id, overall FROM sc")
def llm_score_weighted(spark, sf_dir):
    return scores(spark, sf_dir).select("sample_id", "overall")


CONSENSUS = """verdicts AS (SELECT l.doc_id AS sample_id, CASE WHEN coalesce(fatal, false) THEN 'reject' WHEN coalesce(rate, 1) >= 0.6::DOUBLE AND coalesce(score, 0) >= 0.7::DOUBLE THEN 'accept' ELSE 'revise' END AS verdict,
  round(coalesce(rate, 1::DOUBLE) * coalesce(score, 0::DOUBLE), 4) AS confidence FROM labels l LEFT JOIN gc ON gc.sample_id = l.doc_id LEFT JOIN gs ON gs.sample_id = l.doc_id)"""


@query(f"WITH {CRITIQUES}, {CONSENSUS} SELECT * FROM verdicts")
def consensus_verdict(spark, sf_dir):
    found = V.consensus(labelled(spark, sf_dir), critiques(spark, sf_dir), scores(spark, sf_dir))
    return found.select("sample_id", "verdict", "confidence")


@query(f"WITH {CRITIQUES} SELECT * FROM gj")
def judge_merge(spark, sf_dir):
    return V.merge_judges(judges(spark, sf_dir)).select("sample_id", "verdict", "confidence")


@query(f"""WITH {CRITIQUES} SELECT l.doc_id AS sample_id, CASE WHEN coalesce(fatal, false) OR gj.verdict = 'reject' THEN 'reject'
WHEN gj.verdict = 'accept' AND (l.doc_id % 5) / 4.0::DOUBLE >= 0.34::DOUBLE AND coalesce(rate, 1) >= 0.6::DOUBLE THEN 'accept' ELSE 'revise' END AS verdict,
round(least(coalesce(gj.confidence, 0), (l.doc_id % 5) / 4.0::DOUBLE), 4) AS confidence
FROM labels l LEFT JOIN gc ON gc.sample_id = l.doc_id LEFT JOIN gj ON gj.sample_id = l.doc_id""")
def consensus_with_judges(spark, sf_dir):
    agreed = labelled(spark, sf_dir).withColumn("agreement_ratio", F.col("sample_id") % 5 / 4)
    return V.consensus_with_judges(agreed, critiques(spark, sf_dir), judges(spark, sf_dir))


@query(f"WITH {CRITIQUES}, {CONSENSUS} SELECT verdict, count(*) AS samples FROM verdicts GROUP BY 1")
def verify_counters(spark, sf_dir):
    return V.counters(V.consensus(labelled(spark, sf_dir), critiques(spark, sf_dir), scores(spark, sf_dir)))


@query(f"WITH {CRITIQUES}, {CONSENSUS} SELECT sample_id, verdict FROM verdicts WHERE verdict <> 'reject'")
def accepted_samples(spark, sf_dir):
    return V.accepted(V.consensus(labelled(spark, sf_dir), critiques(spark, sf_dir), scores(spark, sf_dir))).select("sample_id", "verdict")


@query(f"""SELECT conv_id * 100 + turn AS sample_id, conv_id % 3 <> 0 AND conv_id % 5 <> 0 AND length({Q.strip('text')}) >= 20 AS passed,
(conv_id % 3 = 0)::INTEGER + (conv_id % 5 = 0)::INTEGER + (length({Q.strip('text')}) < 20)::INTEGER AS issues FROM conversations""")
def sample_validation(spark, sf_dir):
    c = F.col("conv_id")
    content = F.to_json(F.struct(F.lit("s").alias("sample_id"), F.array(F.lit("d")).alias("source_documents"), F.when(c % 5 != 0, "m").alias("generation_model"), F.when(c % 3 != 0, F.lit("q?")).alias("question"), F.col("text").alias("answer")))
    rows = table(spark, sf_dir, "conversations").select((c * 100 + F.col("turn")).alias("sample_id"), F.parse_json(content).alias("content"))
    return V.sample_issues(rows, ["question", "answer"]).select("sample_id", "passed", F.size("issues").alias("issues"))


# ---- refinement: each round a sample's score rises; some rewrites fail ----


@query(f"""WITH {CRITIQUES}, {CONSENSUS}, r AS (SELECT sample_id, verdict, confidence, sample_id % 4 <> 0 AS ok1, sample_id % 3 <> 0 AS ok2, sample_id % 10 / 10.0::DOUBLE AS s1, sample_id % 10 / 10.0::DOUBLE + 0.25::DOUBLE AS s2 FROM verdicts)
SELECT sample_id, CASE WHEN verdict <> 'revise' THEN verdict WHEN ok1 AND s1 >= 0.7::DOUBLE THEN 'accept' WHEN ok2 AND s2 >= 0.7::DOUBLE THEN 'accept' ELSE 'revise' END AS verdict,
CASE WHEN verdict <> 'revise' THEN 0 WHEN ok1 AND s1 >= 0.7::DOUBLE THEN 1 WHEN ok2 THEN 2 WHEN ok1 THEN 1 ELSE 0 END AS attempt FROM r""")
def refine_rounds(spark, sf_dir):
    verdicts = V.consensus(labelled(spark, sf_dir), critiques(spark, sf_dir), scores(spark, sf_dir)).select("sample_id", "verdict")

    def rewrite(open_rows, attempt):
        return open_rows.where(f"sample_id % {5 - attempt} <> 0")

    def judge(rows, attempt):
        score = F.col("sample_id") % 10 / 10 + (0.25 if attempt == 2 else 0.0)
        return rows.select("sample_id", F.when(score >= V.MIN_SCORE, "accept").otherwise("revise").alias("verdict"))

    return R.refine(verdicts, rewrite, judge, max_retries=2).select("sample_id", "verdict", "attempt")
