"""Queries of generation, formats, trajectories and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import collect as K
from quernstone.operators import formats as R
from quernstone.operators import generate as G
from quernstone.operators import trajectories as X
from quernstone.plans import templates as P
from quernstone.plans.registry import query, table

# ---- plans: parts are subtopics with their brand and type as concepts ----

_BIG, _BATCH = 400, 10
PLAN = """plan AS (SELECT p_partkey AS plan_pos, p_name AS name, [p_brand, p_type] AS concepts, (p_size % 12)::INTEGER AS sample_count,
  [{'level': 'beginner', 'cnt': (p_size % 4)::INTEGER}, {'level': 'intermediate', 'cnt': 4}, {'level': 'advanced', 'cnt': (p_size % 15)::INTEGER}] AS levels FROM part),
cells AS (SELECT plan_pos, name, concepts[c] AS concept, (c - 1)::INTEGER AS concept_pos, levels[l].level AS level, (l - 1)::INTEGER AS level_pos, least(levels[l].cnt, 10) AS cnt FROM plan, (SELECT unnest([1, 2]) AS c), (SELECT unnest([1, 2, 3]) AS l)),
op AS (SELECT *, CASE WHEN min(cnt) OVER (PARTITION BY plan_pos, concept_pos ORDER BY level_pos ROWS UNBOUNDED PRECEDING) > 0 THEN cnt ELSE 0 END AS wanted FROM cells),
tgt AS (SELECT least(400, sum(sample_count)) AS target FROM plan),
expanded AS (SELECT plan_pos, name, concept_pos, concept, level_pos, level, wanted::INTEGER AS wanted,
  greatest(0, least(wanted, target - coalesce(sum(wanted) OVER (ORDER BY plan_pos, concept_pos, level_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INTEGER AS batch FROM op, tgt)"""


def plan(spark, sf_dir):
    level = lambda name, n: F.struct(F.lit(name).alias("level"), n.cast("int").alias("cnt"))
    size = F.col("p_size")
    levels = F.array(level("beginner", size % 4), level("intermediate", F.lit(4)), level("advanced", size % 15))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plan_pos"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("concepts"), (size % 12).cast("int").alias("sample_count"), levels.alias("difficulties"))


@query(f"WITH {PLAN} SELECT * FROM expanded")
def plan_expand(spark, sf_dir):
    return G.expand(plan(spark, sf_dir), _BIG, _BATCH)


@query("""WITH t AS (SELECT doc_id, 0 AS pos, text FROM documents ORDER BY doc_id LIMIT 20)
SELECT md5(string_agg(substr(text, 1, 500), chr(10) || '---' || chr(10) ORDER BY doc_id)) AS digest FROM t""")
def corpus_excerpts(spark, sf_dir):
    """The first 20 excerpts: the limit is the feature."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("chunk"))
    return G.excerpts(chunks).select(F.md5("excerpts").alias("digest"))


_U = "('0x' || substr(md5('42:' || n_nationkey || ':{k}'), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


@query(f"""WITH size AS (SELECT count(*) AS n FROM documents),
first AS (SELECT n_nationkey, n, floor({_U.format(k=0)} * (n - 2))::BIGINT AS p0, floor({_U.format(k=1)} * (n - 1))::BIGINT AS t1, floor({_U.format(k=2)} * n)::BIGINT AS t2 FROM nation, size),
second AS (SELECT *, CASE WHEN t1 = p0 THEN n - 2 ELSE t1 END AS p1 FROM first),
third AS (SELECT n_nationkey, [p0, p1, CASE WHEN t2 IN (p0, p1) THEN n - 1 ELSE t2 END] AS places FROM second),
dealt AS (SELECT n_nationkey, k, dense_rank() OVER (ORDER BY places[k]) - 1 AS rank FROM third, (SELECT unnest([1, 2, 3]) AS k)),
pool AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id || ':0'), doc_id) - 1 AS rank FROM documents)
SELECT n_nationkey, md5(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS digest, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS sources FROM dealt JOIN pool USING (rank) GROUP BY 1""")
def context_sample(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("chunk"))
    found = G.context_sample(table(spark, sf_dir, "nation").select("n_nationkey"), chunks, ["n_nationkey"])
    return found.select("n_nationkey", F.md5("context").alias("digest"), F.array_join("source_ids", ",").alias("sources"))


_DIALOGUES = "dlg AS (SELECT conv_id, count(*) AS turns, min(length(text)) AS least, bool_and(text <> '' AND role <> '') AS filled FROM conversations GROUP BY 1)"


@query("""SELECT conv_id, '{"conversations":[' || string_agg('{"from":"' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || '","value":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS record FROM conversations GROUP BY 1""")
def format_chat_records(spark, sf_dir):
    return R.dialogues(table(spark, sf_dir, "conversations"), "chat")


@query(f"WITH {_DIALOGUES} SELECT conv_id, turns >= 2 AND filled AS valid FROM dlg")
def validate_chat(spark, sf_dir):
    return R.dialogues(table(spark, sf_dir, "conversations"), "chat").select("conv_id", R.is_valid("chat", F.col("record")).alias("valid"))


@query(f"WITH {_DIALOGUES} SELECT conv_id, turns >= 2 AND filled AS valid FROM dlg")
def validate_instruction(spark, sf_dir):
    return R.dialogues(table(spark, sf_dir, "conversations"), "instruction").select("conv_id", R.is_valid("instruction", F.col("record")).alias("valid"))


def responses(spark, sf_dir):
    """Model texts: bare JSON, fenced JSON and plain text by turn."""
    body = F.to_json(F.struct(F.col("text").alias("question"), F.lit("steps").alias("analysis"), F.substring("text", 1, 20).alias("answer")))
    k = F.col("turn") % 3
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), F.lit("m").alias("model"), text.alias("text"), F.lit("concept").alias("concept"), F.lit("topic").alias("name"), F.lit("beginner").alias("level"), F.array(F.lit("d")).alias("source_ids"), F.col("text").alias("raw"))


@query("""SELECT conv_id * 100 + turn AS sample_id, turn % 3 <> 2 AND text <> '' AS valid, CASE WHEN turn % 3 <> 2 THEN text ELSE 'concept' END AS question,
CASE WHEN turn % 3 <> 2 THEN substr(text, 1, 20) ELSE '' END AS answer, 'topic' AS subtopic FROM conversations""")
def parse_responses(spark, sf_dir):
    get = lambda k: F.variant_get("content", k, "string")
    return G.to_samples(responses(spark, sf_dir), "reasoning").select("sample_id", "valid", get("$.question").alias("question"), get("$.answer").alias("answer"), get("$.metadata.subtopic").alias("subtopic"))


# ---- all six formats: model texts with every format's fields, by turn bare, fenced or no JSON ----

_FORMATS = ["reasoning", "instruction", "agent", "coding", "chat", "principles"]


def format_texts(spark, sf_dir):
    x = F.col("text")
    say = lambda who, what, a, b: F.struct(F.lit(who).alias(a), what.alias(b))
    text = lambda **fields: [F.lit(v).alias(k) for k, v in fields.items()]
    body = F.to_json(F.struct(
        *[x.alias(k) for k in ("question", "observation", "issue", "scenario")], *text(analysis="steps", answer="a", thought="t", result="r", investigation="i", patch="p", verification="v", why_rationale="w", solution="s"),
        F.struct(F.lit("search").alias("tool"), F.lit("q").alias("input")).alias("action"), F.array(F.lit("c")).alias("core_principles"), F.array(F.lit("b")).alias("boundary_conditions"),
        F.array(say("user", x, "role", "content"), say("assistant", F.lit("ok"), "role", "content")).alias("messages"), F.array(say("human", x, "from", "value"), say("gpt", F.lit("ok"), "from", "value")).alias("conversations"),
    ))
    k = F.col("turn") % 3
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(x)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), F.lit("m").alias("model"), raw.alias("text"), F.lit("concept").alias("concept"), F.lit("topic").alias("name"), F.lit("beginner").alias("level"), F.array(F.lit("d"), F.lit("e")).alias("source_ids"))


_MAIN = dict(reasoning="$.question", instruction="$.messages[0].content", agent="$.observation", coding="$.issue", chat="$.conversations[0].value", principles="$.scenario")


@query("""SELECT conv_id * 100 + turn AS sample_id, format, text <> '' AND (turn % 3 <> 2 OR format IN ('instruction', 'chat')) AS valid,
CASE WHEN turn % 3 <> 2 THEN text WHEN format = 'instruction' THEN 'You are an expert on topic.' ELSE 'concept' END AS main,
CASE WHEN format IN ('reasoning', 'principles') THEN 'beginner' END AS difficulty
FROM conversations, (SELECT unnest(['reasoning', 'instruction', 'agent', 'coding', 'chat', 'principles']) AS format)""")
def parse_formats(spark, sf_dir):
    texts, out = format_texts(spark, sf_dir), None
    for fmt in _FORMATS:
        own = G.to_samples(texts, fmt).select("sample_id", "format", "valid", F.variant_get("content", _MAIN[fmt], "string").alias("main"), F.try_variant_get("content", "$.metadata.difficulty", "string").alias("difficulty"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT conv_id * 100 + turn AS sample_id, 'm' AS model, 'd,e' AS sources, 'topic' AS template, 'coding' AS format, 'run' AS run_id, conv_id * 100 + turn || '' AS lineage_id FROM conversations WHERE text <> '' AND turn % 3 <> 2""")
def generate_single(spark, sf_dir):
    """Single-shot generation: valid samples and their lineage."""
    line = F.col("lineage")
    made = G.to_samples(format_texts(spark, sf_dir), "coding", "run").where("valid")
    return made.select("sample_id", line["generation_model"].alias("model"), F.array_join(line["source_documents"], ",").alias("sources"), line["template"].alias("template"), line["format"].alias("format"), line["pipeline_run_id"].alias("run_id"), line["sample_id"].alias("lineage_id"))


@query("""WITH c AS (SELECT conv_id, turn, conv_id * 100 + turn AS sample_id, role AS answer FROM conversations WHERE text <> ''),
g AS (SELECT conv_id, answer, count(*) AS size, min(turn) AS first FROM c GROUP BY ALL),
top AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, first) AS k FROM g)
SELECT conv_id AS prompt_id, c.sample_id, size::DOUBLE / n AS agreement_ratio FROM top JOIN c USING (conv_id) WHERE k = 1 AND c.turn = top.first AND (n = 1 OR size >= 2)""")
def generate_consistent(spark, sf_dir):
    """Self-consistent generation: a conversation's turns answer one prompt, those of a role agree."""
    record = F.to_json(F.struct(F.col("text").alias("question"), F.lit("steps").alias("analysis"), F.col("role").alias("answer")))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), F.col("conv_id").alias("prompt_id"), F.col("turn").alias("pos"), F.lit("m").alias("model"), record.alias("text"), F.lit("concept").alias("concept"), F.lit("topic").alias("name"), F.lit("beginner").alias("level"), F.array(F.lit("d")).alias("source_ids"))
    return G.self_consistent(rows, "reasoning").select("prompt_id", "sample_id", "agreement_ratio")


_KEYS = "{'reasoning': 'question, analysis, answer, metadata', 'instruction': 'messages', 'agent': 'observation, thought, action, result', 'coding': 'issue, investigation, patch, verification', 'chat': 'conversations', 'principles': 'scenario, core_principles, why_rationale, solution, boundary_conditions, metadata'}"


@query(f"""SELECT doc_id, format, md5('Write one ' || format || ' record at level advanced about: ' || source || chr(10) || 'Keys: ' || keys || chr(10) || 'Source material:' || chr(10) || substr(text, 1, CASE WHEN format IN ('reasoning', 'principles') THEN 1000 ELSE 800 END)) AS digest
FROM documents, (SELECT unnest(map_keys(m)) AS format, unnest(map_values(m)) AS keys FROM (SELECT MAP {_KEYS} AS m))""")
def format_prompts(spark, sf_dir):
    """The excerpts' lengths are the feature."""
    docs, out = table(spark, sf_dir, "documents"), None
    for fmt in _FORMATS:
        own = docs.select("doc_id", F.lit(fmt).alias("format"), F.md5(R.prompt(fmt, F.col("source"), F.col("text"), F.lit("advanced"))).alias("digest"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS topic, p_partkey % 2 = 0 AS ok, * FROM part)
SELECT topic, 0 AS plan_pos, CASE WHEN ok THEN p_name ELSE topic END AS name, CASE WHEN ok THEN p_brand || ';' || p_type ELSE topic END AS concepts, CASE WHEN ok THEN p_size ELSE 10 END::INTEGER AS sample_count,
  CASE WHEN ok THEN 'beginner:2;advanced:5' ELSE 'beginner:3;intermediate:4;advanced:3' END AS levels FROM p
UNION ALL SELECT topic, 1, p_type, '', 10, 'beginner:3;intermediate:4;advanced:3' FROM p WHERE ok""")
def plan_texts(spark, sf_dir):
    """Plans from model texts; without JSON, the default plan."""
    k = F.col("p_partkey")
    one = F.struct(F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("concepts"), F.col("p_size").alias("sample_count"), F.struct(F.lit(2).alias("beginner"), F.lit(5).alias("advanced")).alias("difficulties"))
    two = F.struct(F.col("p_type").alias("name"))
    body = F.concat(F.lit('```\n{"generation_plan":['), F.to_json(one), F.lit(","), F.to_json(two), F.lit("]}\n```"))
    texts = table(spark, sf_dir, "part").select(k.cast("string").alias("topic"), F.when(k % 2 == 0, body).otherwise("no plan").alias("text"))
    found = G.parse_plan(texts)
    return found.select("topic", "plan_pos", "name", F.array_join("concepts", ";").alias("concepts"), "sample_count", F.array_join(F.transform("difficulties", lambda d: F.concat_ws(":", d["level"], d["cnt"])), ";").alias("levels"))


@query("""SELECT p_partkey::VARCHAR AS topic, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_partkey::VARCHAR] ELSE [p_partkey::VARCHAR, p_partkey || ' guide', p_partkey || ' examples'] END) AS query FROM part""")
def query_texts(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.to_json(F.array("p_brand", "p_type"))).when(k % 3 == 1, '{"queries": 1}').otherwise("none")
    return K.search_queries(table(spark, sf_dir, "part").select(k.cast("string").alias("topic"), text.alias("text")))


@query("""SELECT p_partkey, regexp_replace(p_name || ' (' || p_type || ')', '[^\\p{L}\\p{N}_-]', '_', 'g') AS stem, p_size || '/' || p_partkey AS number FROM part""")
def stems_and_numbers(spark, sf_dir):
    stem = T.file_stem(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
    number = T.first_number(F.concat(F.lit("about "), "p_size", F.lit("/"), "p_partkey", F.lit(" or 3")))
    return table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem"), number.alias("number"))


# ---- trajectories: a conversation's turns are steps ----


def trajectories(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("traj_id"), F.concat(F.lit("task "), "conv_id").alias("task"), F.col("turn").alias("pos"), F.col("text").alias("observation"),
        F.col("role").alias("thought"), F.lit("search").alias("tool"), F.concat(F.lit('{"q":'), F.col("turn"), F.lit("}")).alias("input"), F.length("text").cast("string").alias("result"),
    )
    return X.record(steps)


_STEPS = """WITH first AS (SELECT DISTINCT conv_id AS traj_id, -1 AS turn, 0 AS k, 'system' AS role, 'You are an agent solving: task ' || conv_id AS content, NULL::VARCHAR AS name, NULL::VARCHAR AS arguments FROM conversations)"""


@query(_STEPS + """, m AS (SELECT traj_id, turn, k, role, content FROM first UNION ALL SELECT conv_id, turn, 0, 'user', 'Observation: ' || text FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'assistant', 'Thought: ' || role || chr(10) || 'Action: search({"q":' || turn || '})' || chr(10) || 'Result: ' || length(text) FROM conversations)
SELECT traj_id, (row_number() OVER (PARTITION BY traj_id ORDER BY turn, k) - 1)::INTEGER AS pos, role, content FROM m""")
def traj_react(spark, sf_dir):
    found = X.to_react(trajectories(spark, sf_dir))
    return found.select("traj_id", F.posexplode("messages").alias("pos", "m")).select("traj_id", "pos", "m.role", "m.content")


@query(_STEPS + """, m AS (SELECT * FROM first UNION ALL SELECT conv_id, turn, 0, 'user', text, NULL, NULL FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'assistant', role, NULL, '{"q":' || turn || '}' FROM conversations UNION ALL SELECT conv_id, turn, 2, 'tool', length(text)::VARCHAR, 'search', NULL FROM conversations)
SELECT traj_id, (row_number() OVER (PARTITION BY traj_id ORDER BY turn, k) - 1)::INTEGER AS pos, role, content, name, arguments FROM m""")
def traj_chatml(spark, sf_dir):
    found = X.to_chatml(trajectories(spark, sf_dir))
    rows = found.select("traj_id", F.posexplode("messages").alias("pos", "m"))
    return rows.select("traj_id", "pos", "m.role", "m.content", "m.name", F.col("m.tool_calls")[0]["function"]["arguments"].alias("arguments"))


@query("SELECT doc_id, length(text) > 10000 AS cut, CASE WHEN length(text) > 10000 THEN 10000 + 16 ELSE length(text) END::INTEGER AS n FROM documents")
def terminal_truncate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(t) > X.MAX_OUTPUT).alias("cut"), F.length(X.truncated(t)).alias("n"))


@query(_STEPS + """, m AS (SELECT traj_id, turn, k, role, content FROM first UNION ALL SELECT conv_id, turn, 0, 'user', 'Observation: ' || text FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'assistant', 'Thought: ' || role || chr(10) || 'Action: search({"q":' || turn || '})' || chr(10) || 'Result: ' || length(text) FROM conversations)
SELECT traj_id, '{"messages":[' || string_agg('{"role":"' || role || '","content":' || to_json(content) || '}', ',' ORDER BY turn, k) || ']}' AS record FROM m GROUP BY 1""")
def traj_export(spark, sf_dir):
    return X.messages_json(X.to_react(trajectories(spark, sf_dir)))


@query("""SELECT * FROM (VALUES ('cybersecurity', 50::BIGINT, 20::BIGINT, 200::BIGINT, 273000::BIGINT, 6.09::DOUBLE, 11::BIGINT),
('reasoning', 30, 20, 100, 143000, 3.19, 6), ('coding', 40, 20, 150, 208000, 4.64, 8)) AS t(template, pages, documents, samples, tokens, cost, minutes)""")
def dry_run_plan(spark, sf_dir):
    return P.dry_run(P.as_table(spark))
