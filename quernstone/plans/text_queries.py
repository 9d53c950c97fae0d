"""Queries of the clean stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import clean as C
from quernstone.plans import text_sql as Q
from quernstone.plans.registry import query, table

STRICT = C.CleanSettings(min_quality_score=0.85, max_code_ratio=0.02)


@query(f"SELECT doc_id, {Q.language('text')} AS language FROM documents")
def lang_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(f"SELECT lang, {Q.language('text')} AS language, count(*) AS docs FROM documents GROUP BY ALL")
def lang_confusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", T.detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("docs"))


@query(f"SELECT doc_id, md5({Q.normalize('text')}) AS digest, length({Q.normalize('text')}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    t = T.normalize(F.col("text"))
    return T.nfkc(table(spark, sf_dir, "documents")).select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"))


@query(f"SELECT page_id, md5({Q.normalize('html')}) AS digest FROM pages")
def normalize_html_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalize(F.col("html"))).alias("digest"))


@query(f"SELECT doc_id, md5({Q.strip_boilerplate(Q.normalize('text'))}) AS digest FROM documents")
def strip_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_boilerplate(T.normalize(F.col("text")))).alias("digest"))


@query(f"""WITH base AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
r AS MATERIALIZED (SELECT doc_id, t, {Q.chunks('t', 1000)} AS a FROM base),
c AS (SELECT doc_id, CASE WHEN length(t) <= 1000 THEN [t] ELSE CASE WHEN {Q.strip('a.cur')} <> '' THEN list_append(a.out, {Q.strip('a.cur')}) ELSE a.out END END AS chunks FROM r)
SELECT doc_id, unnest(range(len(chunks)))::INTEGER AS pos, md5(unnest(chunks)) AS digest FROM c""")
def chunk_text(spark, sf_dir):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(doubled, 1000)).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", F.md5("chunk").alias("digest"))


@query(f"SELECT doc_id, round({Q.entropy('text')}, 6) AS entropy FROM documents")
def char_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.char_entropy(F.col("text")), 6).alias("entropy"))


@query(f"SELECT doc_id, coalesce(list_sum(list_transform({Q.words('text')}, lambda w: {Q.syllables('lower(w)')})), 0)::INTEGER AS syllables FROM documents")
def syllables(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.measures(F.col("text"))["n_syllables"].alias("syllables"))


def _features(spark, sf_dir):
    return C.with_features(table(spark, sf_dir, "documents").withColumn("clean", F.col("text")))


_RAW = "WITH raw AS (SELECT *, text AS clean FROM documents)," + Q.features("raw")


@query(_RAW + " SELECT doc_id, round(grade, 6) AS grade FROM scored")
def fk_grade(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", F.round("grade", 6).alias("grade"))


@query(f"SELECT doc_id, round({Q.code_ratio('text')}, 6) AS code FROM documents")
def code_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.code_ratio(F.col("text")), 6).alias("code"))


@query(_RAW + " SELECT doc_id, round(spam, 6) AS spam FROM scored")
def spam_score(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", F.round("spam", 6).alias("spam"))


@query(_RAW + " SELECT doc_id, quality_score FROM scored")
def quality_score(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", C.quality_column().alias("quality_score"))


@query(Q.decided() + " SELECT doc_id, quality_score, drop_reason FROM decided")
def clean_filter(spark, sf_dir):
    return C.decide(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "drop_reason")


@query(Q.decided(0.85, 0.02) + " SELECT doc_id, quality_score, drop_reason FROM decided")
def clean_filter_strict(spark, sf_dir):
    return C.decide(table(spark, sf_dir, "documents"), STRICT).select("doc_id", "quality_score", "drop_reason")


@query(Q.decided() + " SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS docs FROM decided GROUP BY 1")
def clean_drop_reasons(spark, sf_dir):
    return C.counters(C.decide(table(spark, sf_dir, "documents")))


@query(Q.decided(0.85, 0.02) + " SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS docs FROM decided GROUP BY 1")
def clean_drop_reasons_strict(spark, sf_dir):
    return C.counters(C.decide(table(spark, sf_dir, "documents"), STRICT))


@query(_RAW + """ SELECT quality, count(*) AS docs, round(avg(quality_score), 4) AS mean_score, min(quality_score) AS least, max(quality_score) AS most
FROM scored JOIN labels USING (doc_id) GROUP BY quality""")
def quality_vs_label(spark, sf_dir):
    scored = _features(spark, sf_dir).select("doc_id", C.quality_column().alias("score"))
    joined = scored.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return joined.groupBy("quality").agg(F.count("*").alias("docs"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("""WITH t AS (SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents), c AS (SELECT *, tokens / 1000.0::DOUBLE * 0.01::DOUBLE AS raw FROM t)
SELECT doc_id, tokens, round(raw, 6) AS cost, CASE WHEN raw < 0.01 THEN '$' || round(round(raw, 6)::DECIMAL(18, 6), 4)::DECIMAL(18, 4)::VARCHAR ELSE '$' || round(round(raw, 6)::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::VARCHAR END AS shown FROM c""")
def token_estimate(spark, sf_dir):
    n = T.estimate_tokens(F.col("text"))
    cost = T.fallback_cost(n, F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), F.round(cost, 6).alias("cost"), T.format_cost(cost).alias("shown"))
