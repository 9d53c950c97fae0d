"""Record formats: prompts, parsing of model texts with a fallback, the check of required fields, schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T

SYSTEM = {
    "reasoning": "You write reasoning problems for training. Answer with JSON only.",
    "instruction": "You write dialogues in which an expert follows instructions. Answer with JSON only.",
    "agent": "You write single steps of an agent that uses tools. Answer with JSON only.",
    "coding": "You write debugging cases with a tested patch. Answer with JSON only.",
    "chat": "You write natural dialogues about a subject. Answer with JSON only.",
    "principles": "You write scenarios solved from first principles. Answer with JSON only.",
}
#: Required fields by format.
FIELDS = {
    k: v.split()
    for k, v in dict(
        agent="observation thought action result",
        chat="conversations",
        coding="issue investigation patch verification",
        instruction="messages",
        principles="scenario core_principles why_rationale solution boundary_conditions metadata",
        reasoning="question analysis answer metadata",
    ).items()
}
_NEEDED = {k: [f for f in v if f != "metadata" and (k, f) != ("coding", "verification")] for k, v in FIELDS.items()}
_MESSAGES = {"instruction": ("messages", "role", "content"), "chat": ("conversations", "from", "value")}
CONTEXT_CHARS = {"reasoning": 1000, "principles": 1000}
SPARK_SCHEMAS = {
    "reasoning": "question string, analysis string, answer string, metadata map<string,string>",
    "instruction": "messages array<struct<role: string, content: string>>",
    "agent": "observation string, thought string, action variant, result string",
    "coding": "issue string, investigation string, patch string, verification string",
    "chat": "conversations array<struct<`from`: string, value: string>>",
    "principles": "scenario string, core_principles array<string>, why_rationale string, solution string, boundary_conditions array<string>, metadata map<string,string>",
}


def known(fmt: str) -> str:
    """The format, or reasoning for one that isn't known."""
    return fmt if fmt in FIELDS else "reasoning"


def prompt(fmt: str, concept: Column, context: Column, difficulty: Column) -> Column:
    fmt = known(fmt)
    cut = F.substring(context, 1, CONTEXT_CHARS.get(fmt, 800))
    fields = ", ".join(FIELDS[fmt])
    return F.concat(F.lit(f"Write one {fmt} record at level "), difficulty, F.lit(" about: "), concept, F.lit(f"\nKeys: {fields}\nSource material:\n"), cut)


def _fallback(fmt: str, concept: Column, subtopic: Column, raw: Column, difficulty: Column) -> Column:
    about = F.struct(difficulty.alias("difficulty"), subtopic.alias("subtopic"))
    none = F.lit("")
    listed = F.array().cast("array<string>")
    turn = lambda who, text, a, b: F.struct(F.lit(who).alias(a), text.alias(b))
    if fmt == "instruction":
        expert = F.concat(F.lit("You are an expert on "), subtopic, F.lit("."))
        return F.struct(F.array(turn("system", expert, "role", "content"), turn("user", concept, "role", "content"), turn("assistant", raw, "role", "content")).alias("messages"))
    if fmt == "chat":
        return F.struct(F.array(turn("human", concept, "from", "value"), turn("gpt", raw, "from", "value")).alias("conversations"))
    if fmt == "agent":
        return F.struct(concept.alias("observation"), raw.alias("thought"), F.struct(F.lit("search").alias("tool"), concept.alias("input")).alias("action"), none.alias("result"))
    if fmt == "coding":
        return F.struct(concept.alias("issue"), raw.alias("investigation"), none.alias("patch"), none.alias("verification"))
    if fmt == "principles":
        return F.struct(concept.alias("scenario"), listed.alias("core_principles"), raw.alias("why_rationale"), none.alias("solution"), listed.alias("boundary_conditions"), about.alias("metadata"))
    return F.struct(concept.alias("question"), raw.alias("analysis"), none.alias("answer"), about.alias("metadata"))


def parse(fmt: str, raw: Column, concept: Column, subtopic: Column, difficulty: Column) -> Column:
    """A model's text as a record in JSON text. What isn't a JSON object becomes the format's fallback record.

    Reasoning and principles records take difficulty and subtopic from the plan, whatever the model wrote.
    """
    fmt = known(fmt)
    fallback = F.to_json(_fallback(fmt, concept, subtopic, raw, difficulty))
    is_object = lambda text: F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull()
    if fmt not in ("reasoning", "principles"):
        return T.let(T.strip_fence(raw), lambda text: F.when(is_object(text), text).otherwise(fallback))
    fixed = F.map_from_arrays(F.array(F.lit("difficulty"), F.lit("subtopic")), F.array(F.to_variant_object(F.struct(difficulty.alias("v"))), F.to_variant_object(F.struct(subtopic.alias("v")))))
    plain = F.transform_values(fixed, lambda k, v: F.variant_get(v, "$.v", "variant"))

    def merged(entries: Column) -> Column:
        own = F.from_json(F.to_json(F.coalesce(entries["metadata"], F.parse_json(F.lit("{}")))), "map<string,variant>")
        kept = F.map_filter(F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, v: ~k.isin("difficulty", "subtopic"))
        metadata = F.parse_json(F.to_json(F.map_concat(kept, plain)))
        rest = F.map_filter(entries, lambda k, v: k != "metadata")
        return F.to_json(F.map_concat(rest, F.map_from_arrays(F.array(F.lit("metadata")), F.array(metadata))))

    return T.let(T.strip_fence(raw), lambda text: F.when(is_object(text), T.let(F.from_json(text, "map<string,variant>"), merged)).otherwise(fallback))


def _truthy(value: Column) -> Column:
    """Neither missing, null, false, 0, an empty string, list nor object."""
    return T.let(F.to_json(value), lambda text: value.isNotNull() & ~F.is_variant_null(value) & ~text.isin('""', "[]", "{}", "0", "0.0", "false"))


def is_filled(fmt: str, value: Column) -> Column:
    """Whether all fields that the format needs are filled; dialogues have at least two turns, each with both fields filled."""
    fmt = known(fmt)
    filled = lambda v, k: T.let(F.variant_get(v, f"$.{k}", "variant"), _truthy)
    if fmt in _MESSAGES:
        name, who, what = _MESSAGES[fmt]
        each = lambda m: F.coalesce(filled(m, who) & filled(m, what), F.lit(False))
        return F.coalesce(T.let(F.try_variant_get(value, f"$.{name}", "array<variant>"), lambda turns: (F.size(turns) >= 2) & F.forall(turns, each)), F.lit(False))
    out = F.lit(True)
    for k in _NEEDED[fmt]:
        out = out & filled(value, k)
    return F.coalesce(out, F.lit(False))


def is_valid(fmt: str, record: Column) -> Column:
    """``is_filled`` of a record in JSON text; False for other texts."""
    return F.coalesce(T.let(F.try_parse_json(record), lambda value: is_filled(fmt, value)), F.lit(False))


@dataclass(frozen=True)
class Format:
    """A record format as one object, for the registry."""

    name: str

    def system_prompt(self) -> str:
        return SYSTEM[self.name]

    def prompt(self, concept: Column, context: Column, difficulty: Column) -> Column:
        return prompt(self.name, concept, context, difficulty)

    def parse(self, raw: Column, concept: Column, subtopic: Column, difficulty: Column) -> Column:
        return parse(self.name, raw, concept, subtopic, difficulty)

    def is_valid(self, record: Column) -> Column:
        return is_valid(self.name, record)

    def schema(self) -> str:
        return SPARK_SCHEMAS[self.name]


def dialogues(turns: DataFrame, fmt: str = "chat") -> DataFrame:
    """(conv_id, record): the turns (conv_id, turn, role, text) of each conversation as one record of the format."""
    name, who, what = _MESSAGES[fmt]
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")) if fmt == "chat" else F.col("role")
    items = F.array_sort(F.collect_list(F.struct("turn", role.alias("who"), F.col("text").alias("what"))))
    listed = F.transform(items, lambda x: F.struct(x["who"].alias(who), x["what"].alias(what)))
    return turns.groupBy("conv_id").agg(listed.alias(name)).select("conv_id", F.to_json(F.struct(name), {"ignoreNullFields": "false"}).alias("record"))
