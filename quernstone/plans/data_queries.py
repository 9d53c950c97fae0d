"""Queries of dataset validation, metrics, splits, stores and web rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import web as W
from quernstone.operators import collect as K
from quernstone.operators import metrics as M
from quernstone.operators import validate as V
from quernstone.plans import dedup_queries as DQ
from quernstone.plans import text_sql as Q
from quernstone.plans import verify_queries as VQ
from quernstone.plans.registry import query, stream, table
from quernstone.sources import datasets as D
from quernstone.sources import store
from quernstone.sources.shared import shared_path
from quernstone.streaming import incremental as S

# ---- validation of records ----

_MISSING = "SELECT sample_id AS idx, 'missing' AS kind, '{k}' AS key, NULL::VARCHAR AS detail FROM rec WHERE NOT {c} UNION ALL SELECT sample_id, 'empty', '{k}', NULL FROM rec WHERE {c} AND {e}"
_SCHEMA = " UNION ALL ".join(_MISSING.format(k=k, c=c, e=e) for k, c, e in (("question", "q", "text = ''"), ("analysis", "a", "text = ''"), ("answer", "r", "text = ''"), ("metadata", "m", "false")))
_SHORT = " UNION ALL ".join(f"SELECT sample_id AS idx, 'too short' AS kind, '{k}' AS key, length(text)::VARCHAR AS detail FROM rec WHERE {c} AND length({Q.strip('text')}) < 5" for k, c in (("question", "q"), ("analysis", "a"), ("answer", "r")))
_DIFF = """SELECT idx, kind, NULL::VARCHAR AS key, array_to_string(d, ', ') AS detail FROM (
  SELECT k.idx, 'missing keys' AS kind, list_sort(list_filter(f.keys, lambda x: NOT list_contains(k.keys, x))) AS d FROM keyed k, first f WHERE k.idx > f.idx
  UNION ALL SELECT k.idx, 'extra keys', list_sort(list_filter(k.keys, lambda x: NOT list_contains(f.keys, x))) FROM keyed k, first f WHERE k.idx > f.idx) WHERE len(d) > 0"""
_KEYED = "keyed AS (SELECT sample_id AS idx, list_filter([CASE WHEN q THEN 'question' END, CASE WHEN a THEN 'analysis' END, CASE WHEN r THEN 'answer' END, CASE WHEN m THEN 'metadata' END], lambda x: x IS NOT NULL) AS keys FROM rec), first AS (SELECT * FROM keyed ORDER BY idx LIMIT 1)"


def records(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), VQ.record_json().alias("record"))


@query(f"WITH {VQ.RECORDS} {_SCHEMA}")
def schema_errors(spark, sf_dir):
    return V.schema_errors(records(spark, sf_dir), "reasoning")


@query(f"""WITH rec AS (SELECT conv_id * 100 + turn AS idx, turn % 4 = 3 AS none, text, substr(text, 1, (turn % 7)::INTEGER) AS part FROM conversations)
SELECT idx, 'empty record' AS kind, NULL::VARCHAR AS key, NULL::VARCHAR AS detail FROM rec WHERE none
UNION ALL SELECT idx, 'too short', 'question', length(text)::VARCHAR FROM rec WHERE NOT none AND length({Q.strip('text')}) < 5
UNION ALL SELECT idx, 'too short', 'answer', length(part)::VARCHAR FROM rec WHERE NOT none AND length({Q.strip('part')}) < 5""")
def completeness_errors(spark, sf_dir):
    """Answers are cut to a few characters; every fourth turn is a record without keys; metadata may be short."""
    full = F.to_json(F.struct(F.col("text").alias("question"), F.substring("text", F.lit(1), (F.col("turn") % 7).cast("int")).alias("answer"), F.lit("m").alias("metadata"), F.lit(1).alias("count")))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), F.when(F.col("turn") % 4 == 3, "{}").otherwise(full).alias("record"))
    return V.completeness_errors(rows)


@query(f"WITH {VQ.RECORDS}, {_KEYED} {_DIFF}")
def consistency_errors(spark, sf_dir):
    return V.consistency_errors(records(spark, sf_dir))


@query(f"""WITH {VQ.RECORDS}, {_KEYED}, errs AS ({_SCHEMA} UNION ALL {_SHORT} UNION ALL {_DIFF})
SELECT (SELECT count(*) FROM rec) AS total, (SELECT count(*) FROM rec) - count(DISTINCT idx) AS valid, count(*) AS errors, 0::BIGINT AS warnings, round(((SELECT count(*) FROM rec) - count(DISTINCT idx))::DOUBLE / (SELECT count(*) FROM rec), 4) AS pass_rate FROM errs""")
def validation_report(spark, sf_dir):
    return V.report(records(spark, sf_dir), "reasoning")


# ---- diversity: subtopic is the source, the level follows from n_chars, the question is the text ----

LEVEL = "CASE WHEN n_chars < 500 THEN 'beginner' WHEN n_chars < 3000 THEN 'intermediate' ELSE 'advanced' END"
_TOPIC = "(SELECT (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)::DOUBLE) FROM (SELECT count(*)::DOUBLE AS c FROM documents GROUP BY source))"
_BALANCE = f"(SELECT greatest(0, least(1, 1 - stddev_pop(c) / avg(c))) FROM (SELECT count(*) AS c FROM documents GROUP BY {LEVEL}))"
_UNIQUE = "(SELECT count(DISTINCT trim(lower(substr(text, 1, 50)), ' '))::DOUBLE / count(*) FROM documents)"


def diverse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("subtopic"), F.expr(LEVEL).alias("difficulty"), F.col("text").alias("question"))


@query(f"SELECT round({_TOPIC}, 6) AS topic_entropy")
def diversity_topic_entropy(spark, sf_dir):
    return M.topic_entropy(diverse(spark, sf_dir)).select(F.round("topic_entropy", 6).alias("topic_entropy"))


@query(f"SELECT round({_BALANCE}, 6) AS difficulty_balance")
def diversity_difficulty(spark, sf_dir):
    return M.difficulty_balance(diverse(spark, sf_dir)).select(F.round("difficulty_balance", 6).alias("difficulty_balance"))


@query(f"SELECT round({_UNIQUE}, 6) AS prompt_uniqueness")
def diversity_prompts(spark, sf_dir):
    return M.prompt_uniqueness(diverse(spark, sf_dir)).select(F.round("prompt_uniqueness", 6).alias("prompt_uniqueness"))


_DIVERSITY = f"(SELECT round(t, 4) AS topic_entropy, round(b, 4) AS difficulty_balance, round(u, 4) AS prompt_uniqueness, round((t + b + u) / 3, 4) AS overall FROM (SELECT {_TOPIC} AS t, {_BALANCE} AS b, {_UNIQUE} AS u))"


@query(f"SELECT * FROM {_DIVERSITY}")
def diversity_score(spark, sf_dir):
    return M.diversity(diverse(spark, sf_dir))


# ---- benchmark report ----


def verified(spark, sf_dir):
    label = VQ.labelled(spark, sf_dir)
    verdict = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("revise")
    issues = F.when(F.col("toxic") == 1, F.array(F.lit("toxic language"), F.lit("needs review"))).otherwise(F.array(F.lit("low quality")))
    return label.select("sample_id", verdict.alias("verdict"), F.when(F.col("sample_id") % 5 != 0, F.col("sample_id") % 100 / 100).alias("quality_score"), issues.alias("issues"))


_BENCH = """(SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS accepted, count(*) FILTER (WHERE toxic = 1) AS rejected,
round(count(*) FILTER (WHERE toxic = 0 AND quality = 1)::DOUBLE / count(*), 4) AS pass_rate, round(avg(CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) / 100.0::DOUBLE END), 4) AS avg_quality FROM labels)"""


@query(f"SELECT * FROM {_BENCH}")
def benchmark_report(spark, sf_dir):
    return M.benchmark(verified(spark, sf_dir))


@query("SELECT unnest(CASE WHEN toxic = 1 THEN ['toxic language', 'needs review'] ELSE ['low quality'] END) AS reason, count(*) AS samples FROM labels WHERE toxic = 1 OR quality <> 1 GROUP BY 1")
def failure_reasons(spark, sf_dir):
    return M.failure_reasons(verified(spark, sf_dir))


# ---- ledger: events as model calls ----

LIMIT = 1000.0


def ledger(spark, sf_dir):
    model = F.concat(F.lit("model"), F.col("user_id") % 3)
    return table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), model.alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"), F.coalesce(F.col("value"), F.lit(0.0)).alias("cost"))


_LEDGER = "led AS (SELECT ts, event_id AS seq, event_type AS stage, 'model' || (user_id % 3) AS model, user_id AS tokens_in, user_id * 2 AS tokens_out, coalesce(value, 0) AS cost FROM events)"
_RUN = f"{_LEDGER}, run AS (SELECT *, sum(cost) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS spent FROM led)"


@query(f"WITH {_LEDGER} SELECT stage, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost FROM led WHERE stage <> '' AND model <> '' GROUP BY ALL")
def cost_by_stage_model(spark, sf_dir):
    return M.cost_by(ledger(spark, sf_dir), "stage", "model")


@query(f"WITH {_LEDGER} SELECT stage, model, count(*) AS calls, round(sum(cost), 6) AS cost FROM led GROUP BY ROLLUP (stage, model)")
def cost_rollup(spark, sf_dir):
    return M.cost_rollup(ledger(spark, sf_dir))


@query(f"WITH {_RUN} SELECT seq, round(spent, 4) AS spent, round(greatest(0, {LIMIT} - spent), 4) AS remaining, round(spent, 6) > {LIMIT} AS over FROM run")
def budget_running(spark, sf_dir):
    return M.running(ledger(spark, sf_dir), LIMIT).select("seq", F.round("spent", 4).alias("spent"), F.round("remaining", 4).alias("remaining"), (F.round("spent", 6) > LIMIT).alias("over"))


@query(f"WITH {_RUN} SELECT seq, stage, round(spent, 4) AS spent FROM run WHERE spent > {LIMIT} ORDER BY ts, seq LIMIT 1")
def budget_first_breach(spark, sf_dir):
    return M.first_breach(ledger(spark, sf_dir), LIMIT).select("seq", "stage", F.round("spent", 4).alias("spent"))


@query(f"""WITH {_LEDGER}, one AS (SELECT (SELECT count(*) - count(DISTINCT md5(text)) FROM documents)::DOUBLE / (SELECT count(*) FROM documents) AS dup,
(SELECT ({_TOPIC} + {_BALANCE} + {_UNIQUE}) / 3) AS div, (SELECT count(*) FILTER (WHERE toxic = 0 AND quality = 1)::DOUBLE / count(*) FROM labels) AS pass, (SELECT sum(cost) FROM led) AS cost)
SELECT 'duplicates' AS gate, dup <= 0.1::DOUBLE AS passed, round(dup, 4) AS actual, 0.1::DOUBLE AS threshold FROM one UNION ALL SELECT 'diversity', round(div, 4) >= 0.5::DOUBLE, round(div, 4), 0.5::DOUBLE FROM one
UNION ALL SELECT 'verification', round(pass, 4) >= 0.6::DOUBLE, round(pass, 4), 0.6::DOUBLE FROM one UNION ALL SELECT 'budget', cost <= {LIMIT}, round(cost, 4), {LIMIT}::DOUBLE FROM one""")
def gate_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), (F.count("*") - F.countDistinct(F.md5("text"))).alias("duplicates"))
    one = docs.crossJoin(M.diversity(diverse(spark, sf_dir)).select(F.col("overall").alias("diversity"))).crossJoin(M.benchmark(verified(spark, sf_dir)).select("pass_rate")).crossJoin(ledger(spark, sf_dir).agg(F.sum("cost").alias("cost")))
    return M.gates(one, M.Limits(max_cost=LIMIT))


# ---- splits, flattening, stores ----

_ORDERED = "ord AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents)"
_SPLIT = "CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END"


@query(f"WITH {_ORDERED} SELECT doc_id, {_SPLIT} AS split FROM ord")
def split_assign(spark, sf_dir):
    return D.with_splits(table(spark, sf_dir, "documents").select("doc_id"))


@query(f"WITH {_ORDERED} SELECT {_SPLIT} AS split, count(*) AS docs FROM ord GROUP BY 1")
def split_sizes(spark, sf_dir):
    return D.with_splits(table(spark, sf_dir, "documents").select("doc_id")).groupBy("split").agg(F.count("*").alias("docs"))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def jsonl_roundtrip(spark, sf_dir):
    at = shared_path(spark, "roundtrip") + "/turns.jsonl"
    D.to_jsonl(table(spark, sf_dir, "conversations"), at)
    value = F.parse_json("record")
    return D.from_jsonl(spark, at).select(F.variant_get(value, "$.conv_id", "long").alias("conv_id"), F.variant_get(value, "$.turn", "long").alias("turn"), F.md5(F.variant_get(value, "$.text", "string")).alias("digest"))


@query("""SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS turns FROM conversations GROUP BY 1""")
def parquet_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    at = shared_path(spark, "flat")
    D.to_parquet(nested, at)
    return D.from_parquet(spark, at)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def kv_upsert_latest(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


# ---- files: lines with their numbers, positions over a folder, export ----

_LINES = "lines AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)"


def _written(spark, sf_dir, label):
    """The turns as lines of one file in order: every fifth is blank, every seventh broken."""
    at = shared_path(spark, label) + "/turns.jsonl"
    n = F.row_number().over(Window.orderBy("conv_id", "turn"))  # a fixture of a few lines, numbered to tell what is to be read
    line = F.when(F.col("n") % 5 == 0, "  ").when(F.col("n") % 7 == 0, F.concat(F.lit('{"broken": '), F.to_json(F.struct("text")))).otherwise(F.to_json(F.struct("conv_id", "turn", "text")))
    D._write_text(table(spark, sf_dir, "conversations").withColumn("n", n).select(line.alias("value")), at, True)
    return at


@query(f"WITH {_LINES} SELECT n AS line, n % 7 <> 0 AS ok FROM lines WHERE n % 5 <> 0")
def jsonl_line_numbers(spark, sf_dir):
    return D.read_lines(spark, _written(spark, sf_dir, "lines")).select("line", "ok")


@query(f"WITH {_LINES} SELECT row_number() OVER (ORDER BY n) - 1 AS idx, md5(text) AS digest FROM lines WHERE n % 5 <> 0 AND n % 7 <> 0")
def jsonl_positions(spark, sf_dir):
    at = _written(spark, sf_dir, "positions")
    found = D.indexed(D.from_directory(spark, at.rpartition("/")[0]))
    return found.select("idx", F.md5(F.variant_get(F.parse_json("record"), "$.text", "string")).alias("digest"))


@query("SELECT '{\"id\":' || doc_id || '}' AS line FROM labels WHERE NOT (toxic = 1) UNION ALL SELECT 'total ' || count(*) FROM labels WHERE NOT (toxic = 1)")
def export_dataset(spark, sf_dir):
    """The exported lines and the metadata's total; rejected samples stay out."""
    out = shared_path(spark, "export")
    rows = table(spark, sf_dir, "labels").select(F.to_variant_object(F.struct(F.col("doc_id").alias("id"))).alias("content"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").alias("verdict"))
    D.export(rows, "a topic", out)
    about = spark.read.text(f"{out}/a_topic_metadata.json").select(F.concat(F.lit("total "), F.get_json_object("value", "$.total_samples")).alias("line"))
    return spark.read.text(f"{out}/a_topic_dataset.jsonl").select(F.col("value").alias("line")).unionByName(about)


@query("""SELECT c_custkey::VARCHAR AS doc_id, CASE WHEN c_nationkey = 3 THEN '{"again":' || c_custkey || '}' ELSE '{"name":"' || c_name || '"}' END AS data FROM customer WHERE c_custkey <> 2
UNION ALL SELECT 'state', '{"stage":"clean"}' UNION ALL SELECT 'one', '{"name":"Customer#000000001"}' UNION ALL SELECT 'none', NULL""")
def store_documents(spark, sf_dir):
    """Saved, replaced and deleted documents, one that is loaded, one that isn't there, and a run's state."""
    kept = store.ParquetStore(spark, shared_path(spark, "store"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_nationkey", "c_name", "c_custkey")
    kept.save("customers", own.select("doc_id", F.to_json(F.struct(F.col("c_name").alias("name"))).alias("data")))
    kept.save("customers", own.where("c_nationkey = 3").select("doc_id", F.to_json(F.struct(F.col("c_custkey").alias("again"))).alias("data")))
    kept.delete("customers", "2")
    kept.save_state("run", '{"stage":"clean"}')
    first = kept.load("customers", "1")
    single = spark.createDataFrame([("state", kept.load_state("run")), ("one", first), ("none", kept.load("customers", "2"))], "doc_id string, data string")
    return kept.documents("customers").unionByName(single)


@query("SELECT conv_id * 100 + turn AS idx, 'metadata is no object' AS kind, 'metadata' AS key, NULL::VARCHAR AS detail FROM conversations WHERE turn % 3 > 0")
def lineage_warnings(spark, sf_dir):
    """Metadata that is text or a list, not an object."""
    k = F.col("turn") % 3
    record = F.concat(F.lit('{"metadata": '), F.when(k == 0, '{"difficulty": "easy"}').when(k == 1, F.to_json(F.array("text"))).otherwise(F.lit('"none"')), F.lit("}"))
    return V.lineage_warnings(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), record.alias("record")))


@query("""SELECT conv_id * 100 + turn AS idx, CASE WHEN turn % 2 = 0 THEN 'missing' ELSE 'empty' END AS kind, 'conversations' AS key, NULL::VARCHAR AS detail FROM conversations""")
def schema_errors_chat(spark, sf_dir):
    record = F.when(F.col("turn") % 2 == 0, '{"messages": []}').otherwise('{"conversations": []}')
    return V.schema_errors(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), record.alias("record")), "chat")


@query("""SELECT event_id, model, CASE model WHEN 'gpt-4o' THEN user_id / 1000000.0::DOUBLE * 2.5::DOUBLE + user_id * 2 / 1000000.0::DOUBLE * 10::DOUBLE WHEN 'gpt-4o-mini' THEN user_id / 1000000.0::DOUBLE * 0.15::DOUBLE + user_id * 2 / 1000000.0::DOUBLE * 0.6::DOUBLE
ELSE user_id / 1000.0::DOUBLE * 0.01::DOUBLE + user_id * 2 / 1000.0::DOUBLE * 0.03::DOUBLE END AS cost FROM (SELECT *, ['gpt-4o', 'gpt-4o-mini', 'another'][user_id % 3 + 1] AS model FROM events)""")
def model_cost(spark, sf_dir):
    u = F.col("user_id")
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o", "gpt-4o-mini", "another"))), (u % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", model.alias("model"), T.cost(model, u, u * 2).alias("cost"))


# ---- streams, read to their end ----


@query(f"WITH {_LEDGER} SELECT stage, model, round(sum(cost), 6) AS cost FROM led GROUP BY ALL")
def stream_ledger(spark, sf_dir):
    name = f"spent_{uuid.uuid4().hex}"
    calls = stream(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("model"), F.col("user_id") % 3).alias("model"), F.coalesce(F.col("value"), F.lit(0.0)).alias("cost"))
    run = S.spent(calls).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_path(spark, "ledger")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("stage", "model", F.round("cost", 6).alias("cost"))


@query(DQ.WALK + " SELECT doc_id FROM decided WHERE NOT is_duplicate")
def stream_dedup(spark, sf_dir):
    at = shared_path(spark, "stream")
    S.dedup_stream(stream(spark, sf_dir, "documents").select("doc_id", "text"), f"{at}/registry", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id")


# ---- web ----

LISTED = ["example.org", "m.example.com"]
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"


@query(f"SELECT page_id, {_HOST} AS host, {_HOST} IN ('example.org', 'm.example.com') OR suffix({_HOST}, '.example.org') OR suffix({_HOST}, '.m.example.com') AS blocked FROM pages")
def blocked_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.host(F.col("url")).alias("host"), W.is_blocked(F.col("url"), LISTED).alias("blocked"))


@query("SELECT page_id::VARCHAR AS query, 0 AS pos, url FROM pages UNION ALL SELECT page_id::VARCHAR, 1, 'https://example.com/a b?' || page_id FROM pages")
def search_links(spark, sf_dir):
    """Result pages that link to a page directly, twice, by a redirect and to themselves."""
    link = lambda *u: F.concat(F.lit('<a href="'), *u, F.lit('">x</a>'))
    direct = link("url")
    html = F.concat(direct, link(F.lit("/here")), link(F.lit("//s.example/l/?uddg=https%3A%2F%2Fexample.com%2Fa%20b%3F"), "page_id", F.lit("&amp;rut=1")), direct)
    return K.search_urls(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("query"), html.alias("html")))


@query("SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def url_dedup(spark, sf_dir):
    return K.first_urls(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "url")


@query("SELECT page_id, CASE WHEN suffix(lower(url), '.pdf') THEN 'application/pdf' WHEN suffix(lower(url), '.md') OR suffix(lower(url), '.txt') THEN 'text/plain' ELSE 'text/html' END AS content_type FROM pages")
def content_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.content_type(F.col("url")).alias("content_type"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.html_title(F.col("html")).alias("title"))


@query()
def html_text(spark, sf_dir):
    """HTML isn't regular: tests hold the parser against hand-written pages."""
    return table(spark, sf_dir, "pages").select("page_id", W.html_text("html").alias("text"))


@query()
def page_word_filter(spark, sf_dir):
    return K.enough_words(K.extracted(K.allowed(K.first_urls(table(spark, sf_dir, "pages"), ["page_id"])))).select("page_id", "title", "word_count")


@query()
def collect_pages(spark, sf_dir):
    return K.collect(table(spark, sf_dir, "pages")).select("page_id", "content_hash", "word_count")


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 50")
def page_limit(spark, sf_dir):
    """At most 50 pages a run: the limit is the feature."""
    return K.limited(table(spark, sf_dir, "pages"), 50, ["page_id"]).select("page_id", "url")
