"""Quality rule: distribution divergence from a language's reference.

Two histograms of a document, its character classes and its language's common words (with one bin for all other words),
are compared with the same histograms summed over all documents of the language, by the Jensen-Shannon distance (base 2).
A document fails where either distance is over its limit; a sample of n words strays from its reference by about 1 / sqrt(n),
so the words' limit is ``MAX_WORDS_DISTANCE`` + ``WORDS_SLACK`` / sqrt(n). Documents with fewer than ``MIN_CHARS`` characters, or fewer than
``MIN_WORDS`` words for the words' distance, are too short to judge and pass.

Common words are those that make up at least ``COMMON_SHARE`` of all words of a language's documents, of any language that there
is. A word of that share has it in one task's documents at least, so a first pass gathers the words that have it in any task; a
second counts these, exactly, over all documents. Histograms are counted per document and checkpointed as two short arrays. What
is gathered is a row for each language, with no more words than tasks / ``COMMON_SHARE`` and some tens of them as a rule; it
is broadcast where it has at most ``MAX_BROADCAST`` numbers, and else joined over ``SALTS`` parts of each language.

Defined results: a null or empty text has distances null and passes; documents with a null language form a language of their
own; a language without a common word has the one bin for words (distance 0); very long texts are counted whole; repeated rows count as
often as they occur and get equal results, as do ties; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import checkpointed, code_points, map_rows, text_groups

MIN_CHARS, MIN_WORDS, MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE, WORDS_SLACK = 200, 40, 0.25, 0.3, 0.6
CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "letter", "other"]
#: The least share of a common word; how many numbers of references are broadcast, and the parts of a language beyond.
COMMON_SHARE, MAX_BROADCAST, SALTS = 0.01, 2_000_000, 64
_STOP = set(".,;:!?")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    def of(c: int) -> int:
        ch = chr(c)
        k = unicodedata.category(ch)
        return 3 if ch in " \t\n\r" else 4 if ch in _STOP else 0 if k == "Ll" else 1 if k == "Lu" else 2 if k == "Nd" else 6 if k[0] == "L" else 5 if k[0] in "PS" else 7

    return np.array([of(c) for c in range(0x110000)], np.int64)


def char_histograms(texts: list) -> np.ndarray:
    out = [np.zeros((0, len(CLASSES)), np.int64)]
    for a, b in text_groups(texts):
        codes, doc = code_points(texts[a:b])
        keep = np.concatenate([doc[1:] == doc[:-1], [False]])  # all but the 0 that ends each text
        kind = _classes()[codes[keep]]
        out.append(np.bincount(doc[keep] * len(CLASSES) + kind, minlength=(b - a) * len(CLASSES)).reshape(b - a, len(CLASSES)))
    return np.concatenate(out)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def candidates(docs: DataFrame, share: float = COMMON_SHARE) -> dict[str | None, list[str]]:
    """By language the words that have the share in the documents of any one task."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str | None, Counter] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                found.setdefault(lang if isinstance(lang, str) else None, Counter()).update(words_of(text))
        least = {lang: share * own.total() for lang, own in found.items()}
        rows = [(lang, w) for lang, own in found.items() for w, n in own.items() if n >= least[lang]]
        if rows:
            yield pd.DataFrame(rows, columns=["lang", "word"])

    out: dict[str | None, list[str]] = {}
    for r in docs.select("lang", "text").where("text IS NOT NULL").mapInPandas(count, "lang string, word string").distinct().collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return {k: sorted(v) for k, v in out.items()}


def word_histogram(text: str | None, number: dict[str, int]) -> list[int]:
    """How often a text has each of the numbered words, and last, how many others it has."""
    out = [0] * (len(number) + 1)
    for w, n in Counter(words_of(text)).items():
        out[number.get(w, -1)] += n
    return out


def histograms(docs: DataFrame, listed: dict[str | None, list[str]]) -> DataFrame:
    """(doc_id, lang, n_chars, n_words, chars, words) of every row."""
    number = {k: {w: i for i, w in enumerate(v)} for k, v in listed.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f["text"]]
            chars = char_histograms(texts)
            words = [word_histogram(t, number.get(k if isinstance(k, str) else None, {})) for t, k in zip(texts, f["lang"])]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang": f["lang"], "n_chars": chars.sum(1), "n_words": [sum(w) for w in words], "chars": list(chars), "words": words})

    return map_rows(docs.select("doc_id", "lang", "text"), run, "doc_id long, lang string, n_chars long, n_words long, chars array<long>, words array<long>")


def references(own: DataFrame, listed: dict[str | None, list[str]], share: float = COMMON_SHARE) -> list[tuple]:
    """(language, shares of the character classes, places of the common words among the listed, their shares and that of all others)."""
    width = max(map(len, listed.values()), default=0) + 1
    summed = lambda column, size: F.array(*[F.coalesce(F.sum(F.get(column, F.lit(k))), F.lit(0)) for k in range(size)])
    out = []
    for lang, chars, words in own.groupBy("lang").agg(summed("chars", len(CLASSES)), summed("words", width)).collect():
        n = sum(words)
        places = [k for k in range(len(listed.get(lang, []))) if words[k] >= share * n]
        rest = n - sum(words[k] for k in places)
        out.append((lang, [c / max(1, sum(chars)) for c in chars], places, [x / max(1, n) for x in [*(words[k] for k in places), rest]]))
    return out


def _distance(counts: Column, n: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of n things in counts from the reference's shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(F.transform(counts, lambda c: c / n), reference, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(docs: DataFrame, max_chars_distance: float = MAX_CHARS_DISTANCE, max_words_distance: float = MAX_WORDS_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, chars_distance, words_distance, keep)."""
    listed = candidates(docs)
    own = checkpointed(histograms(docs, listed))
    found = references(own, listed)
    reference = docs.sparkSession.createDataFrame(found, "language string, ref_chars array<double>, places array<int>, ref_words array<double>")
    if sum(len(r[1]) + len(r[2]) + len(r[3]) for r in found) <= MAX_BROADCAST:
        joined = own.join(F.broadcast(reference), F.col("lang").eqNullSafe(F.col("language")))
    else:
        parts = reference.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS))).join(parts, F.col("lang").eqNullSafe(F.col("language")) & (F.col("salt") == F.col("part")))
    common = F.transform("places", lambda k: F.get("words", k))
    binned = joined.withColumn("common", common).withColumn("binned", F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x))))
    chars = F.when(F.col("n_chars") >= min_chars, F.round(_distance(F.col("chars"), F.col("n_chars"), F.col("ref_chars")), 6))
    words = F.when((F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words), F.round(_distance(F.col("binned"), F.col("n_words"), F.col("ref_words")), 6))
    judged = binned.select("doc_id", "n_words", chars.alias("chars_distance"), words.alias("words_distance"))
    limit = F.lit(max_words_distance) + F.lit(WORDS_SLACK) / F.sqrt(F.greatest("n_words", F.lit(1)))
    keep = (F.coalesce("chars_distance", F.lit(0.0)) <= max_chars_distance) & (F.coalesce("words_distance", F.lit(0.0)) <= limit)
    return judged.select("doc_id", "chars_distance", "words_distance", keep.alias("keep"))
