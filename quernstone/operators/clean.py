"""The clean stage: features, ordered drop reasons, chunks, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T


@dataclass(frozen=True)
class CleanSettings:
    language: str = "en"
    max_chunk_size: int = 4000
    max_code_ratio: float = 0.4
    min_char_entropy: float = 3.0
    min_quality_score: float = 0.3
    min_text_length: int = 200


def with_features(df: DataFrame, column: str = "clean") -> DataFrame:
    """``df`` with the counts and ratios of ``column`` that the quality score needs."""
    t, found = F.col(column), F.col("__measures")
    counted = df.withColumn("__measures", T.measures(t)).select(
        *df.columns,
        F.length(t).alias("n_chars_clean"),
        *[found[k].alias(k) for k in ("n_words", "n_sentences", "n_syllables", "entropy")],
        T.code_ratio(t).alias("code"),
        found["spam"].alias("spam"),
    )
    return counted.withColumn("grade", T.flesch_kincaid(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")))


def quality_column() -> Column:
    c = F.col
    return T.quality(c("n_chars_clean"), c("n_words"), c("n_sentences"), c("grade"), c("entropy"), c("code"), c("spam"))


def decide(docs: DataFrame, settings: CleanSettings = CleanSettings(), nfkc: bool = True) -> DataFrame:
    """``docs`` with ``clean`` (text), ``quality_score`` and ``drop_reason`` (null: kept); the first failing rule counts.

    Length and language are decided on the raw text, before the costly features, which are computed for the rest only.
    """
    raw = docs.withColumn("language", T.detect_language(F.col("text")))
    early = F.when(F.coalesce(F.length("text"), F.lit(0)) < settings.min_text_length, "short").when(F.col("language") != settings.language, "language")
    # Texts that an early rule drops become null, which costs the later columns nothing.
    marked = raw.withColumn("early", early).withColumn("__open", F.when(F.col("early").isNull(), F.col("text")))
    if nfkc:
        marked = T.nfkc(marked, "__open")
    cleaned = marked.withColumn("clean", T.strip_boilerplate(T.normalize(F.col("__open")))).drop("__open")
    scored = with_features(cleaned).withColumn("quality_score", F.when(F.col("early").isNull(), quality_column()))
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("n_chars_clean") < settings.min_text_length, "short")
        .when(F.col("code") > settings.max_code_ratio, "code")
        .when(F.col("quality_score") < settings.min_quality_score, "quality")
        .when(F.col("entropy") < settings.min_char_entropy, "quality")
    )
    return scored.withColumn("drop_reason", reason).select(*docs.columns, "language", "clean", "quality_score", "drop_reason")


def clean(docs: DataFrame, settings: CleanSettings = CleanSettings()) -> DataFrame:
    """(doc_id, chunks, language, quality_score, word_count) of the documents that stay."""
    kept = decide(docs, settings).where("drop_reason IS NULL")
    return kept.select("doc_id", T.chunks(F.col("clean"), settings.max_chunk_size).alias("chunks"), "language", "quality_score", F.size(T.words(F.col("clean"))).alias("word_count"))


def counters(decided: DataFrame) -> DataFrame:
    """(drop_reason, docs): how many documents each rule dropped, and 'kept'."""
    return decided.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("docs"))


def chunk_rows(cleaned: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk): one row for each chunk."""
    return cleaned.select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))
