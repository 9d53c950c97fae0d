"""The collect stage over tables: search results, URL dedup, blocked domains, page limits, extraction, word filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import web as W
from quernstone.operators import dedup


def search_urls(results: DataFrame, max_results: int = 8) -> DataFrame:
    """(query, pos, url) from fetched result pages (query, html); failed ones (null) give nothing."""
    return results.select("query", F.posexplode(F.slice(W.result_links(F.col("html")), 1, max_results)).alias("pos", "url"))


def first_urls(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each URL once, where it comes first in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("__n = 1").drop("__n")


def allowed(rows: DataFrame, blocked: list[str] = W.BLOCKED) -> DataFrame:
    return rows.where(~W.is_blocked(F.col("url"), blocked))


def limited(rows: DataFrame, max_pages: int, order: list[str]) -> DataFrame:
    """The first pages; the limit is the feature."""
    return rows.orderBy(*order).limit(max_pages)


def extracted(pages: DataFrame, min_content_length: int = 200) -> DataFrame:
    """(page_id, url, title, content, content_type, content_hash, word_count) of pages with enough text; PDFs are skipped."""
    html = pages.where(W.content_type(F.col("url")) != "application/pdf").withColumn("content", W.main_text(F.col("html")))
    long = html.where(F.length("content") >= min_content_length)
    return long.select("page_id", "url", W.html_title(F.col("html")).alias("title"), "content", W.content_type(F.col("url")).alias("content_type"), F.md5("content").alias("content_hash"), F.size(T.words(F.col("content"))).alias("word_count"))


def enough_words(docs: DataFrame, min_words: int = 100) -> DataFrame:
    return docs.where(F.col("word_count") >= min_words)


def collect(pages: DataFrame, blocked: list[str] = W.BLOCKED, min_content_length: int = 200, min_words: int = 100) -> DataFrame:
    """Pages to documents: (page_id, url, title, content, ...) without blocked, repeated, short and duplicate ones."""
    docs = enough_words(extracted(allowed(first_urls(pages, ["page_id"]), blocked), min_content_length), min_words)
    return dedup.keep(docs.withColumnRenamed("content", "text"), order="page_id").withColumnRenamed("text", "content")


def default_queries(topic: str) -> list[str]:
    return [topic, f"{topic} guide", f"{topic} examples"]


def search_queries(responses: DataFrame) -> DataFrame:
    """(topic, query) from model texts (topic, text): a JSON list of strings; other JSON gives the topic, no JSON three defaults."""
    text = T.strip_fence(F.col("text"))
    parsed = F.try_parse_json(text)
    listed = F.from_json(text, "array<string>")
    topic = F.col("topic")
    defaults = F.array(topic, F.concat(topic, F.lit(" guide")), F.concat(topic, F.lit(" examples")))
    queries = F.when(parsed.isNull(), defaults).when(F.schema_of_variant(parsed).startswith("ARRAY"), listed).otherwise(F.array(topic))
    return responses.select("topic", F.explode(queries).alias("query"))
