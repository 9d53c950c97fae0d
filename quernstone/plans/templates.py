"""Dataset templates and the dry run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import fallback_cost

#: name: (description, format, pages, samples, seed topics, guidelines)
TEMPLATES = {
    "cybersecurity": (
        "Security analysis and incident response", "reasoning", 50, 200,
        ["phishing", "ransomware", "network scans", "access control", "log analysis", "patching", "encryption", "key rotation", "incident response",
         "forensics", "threat models", "web injection", "privilege escalation", "cloud security", "supply chains", "zero trust", "malware triage"],
        "State the evidence, the likely cause and the defence; never give working exploits.",
    ),
    "reasoning": (
        "Step-by-step problems with a checkable answer", "reasoning", 30, 100,
        ["arithmetic", "algebra", "geometry", "probability", "logic puzzles", "causality", "estimation", "analogy", "planning", "proofs", "paradoxes", "statistics"],
        "Show each step and end with a short answer.",
    ),
    "coding": (
        "Bugs, their investigation and a tested patch", "coding", 40, 150,
        ["off-by-one", "race conditions", "memory leaks", "null handling", "encoding", "time zones", "caching", "SQL queries", "API design", "recursion",
         "numeric precision", "file handles", "retries", "input checks"],
        "Give a minimal failing case, the reason and the patch.",
    ),
}
TOKENS_IN, TOKENS_OUT, COLLECT_ITEMS = 500, 800, 10


def as_table(spark: SparkSession) -> DataFrame:
    rows = [(k, d, f, p, s, topics, g) for k, (d, f, p, s, topics, g) in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template string, description string, format string, pages long, samples long, seed_topics array<string>, guidelines string")


def dry_run(templates: DataFrame, max_documents: int = 20) -> DataFrame:
    """(template, pages, documents, samples, tokens, cost, minutes): estimates, no call is made."""
    items = F.col("samples") + COLLECT_ITEMS
    tokens = items * (TOKENS_IN + TOKENS_OUT)
    cost = fallback_cost(items * TOKENS_IN, items * TOKENS_OUT)
    minutes = F.greatest(F.lit(1).cast("long"), F.floor((F.col("pages") * 2 + F.col("samples") * 3) / 60))
    return templates.select("template", "pages", F.least("pages", F.lit(max_documents).cast("long")).alias("documents"), "samples", tokens.alias("tokens"), F.round(cost, 4).alias("cost"), minutes.alias("minutes"))
