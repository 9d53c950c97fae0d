import pytest

LONG = "the quick brown fox and the lazy dog are in the garden. " * 40_000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, None, None, None, None), (None, "a text without an id that is long enough to be read as a text of its own", "en", "web", None),
    (2, "", "en", "web", 0), (3, "   \n\t ", None, "web", 5), (4, "!!! ??? ...", "en", None, 11), (5, "x", "en", "books", 1),
    (6, "the cat sat on the mat and looked at the dog", "en", "books", 44), (6, "the cat sat on the mat and looked at the dog", "en", "books", 44),
    (7, "the cat sat on the mat and looked at the dog", "fr", "web", 44), (8, "日本語のテキスト 𝒳 \U0001f600", "xx", "web", 12),
    (9_007_199_254_740_993, LONG, "en", "web", len(LONG)), (None, None, None, None, None),
]
#: Names that operators use for columns of their own.
CLASHING = ["n", "hi", "lo", "th", "triples", "keep_id", "node", "root", "u", "v", "shard", "bin", "tokens", "chars", "start", "language", "keep", "severity", "toxic", "epochs", "size", "docs",
            "weight", "__times", "__n", "__epochs", "__source", "__id", "__th", "__same", "row", "id", "host", "suffix", "url", "clip", "window", "count", "copies", "duplicate_of", "key", "a", "b", "c"]


@pytest.fixture
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, ids that doubles can't hold."""
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture
def clashing(nasty):
    from pyspark.sql import functions as F

    return nasty.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 1), (6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
