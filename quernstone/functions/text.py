"""Text rules as column expressions: normalisation, boilerplate, chunks, readability, code and spam ratios, quality, language.

Most of it stays in the JVM. NFKC isn't a Spark function; ``nfkc`` applies it to the few rows that it can change. Counts over every
word or character of a text (``measures``, ``char_entropy``) are taken in Python: lambdas of the JVM cost about ten times as much.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import compress
from operator import and_, eq, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

#: Common English words, for the share that makes a text English.
ENGLISH = sorted(
    """about after all also an and any as at a back be because but by can come could day do even first for from get give
    good go have her he him his how if into in its it i just know like look make me most my new not now no of one only on
    other our out over or people say see she some so take than that their them then there these they the think this time
    to two up use us want way well we what when which who will with work would year your you""".split()
)
BOILERPLATE = "(?iu)" + "|".join(
    [
        r"(?:partner\s+content|promoted|sponsored|advertisement)",
        r"(?:see\s+more|learn\s+more|click\s+here|read\s+more)",
        r"(?:skip\s+ad|please\s+wait|loading\.\.\.)",
        r"(?:all\s+rights\s+reserved|privacy\s+policy|terms\s+of\s+(?:use|service))",
        r"(?:pin|tweet|like|follow|share)\s+(?:us|on|this)",
        r"(?:newsletter|subscribe|sign up)\s+(?:to|for|today|now)",
        r"cookies?\s+(?:banner|consent|notice|policy)",
    ]
)
URL, EMAIL = r"https?://\S+", r"(?U)\b[-+.\w]+@[-\w]+\.[-.\w]+\b"
CODE_PATTERNS = [
    r"```[\s\S]*?```",
    r"`[^`\n]+`",
    r"(?dm)^\s*(?:(?:class|const|def|from|function|import|let|var) |(?:for|if|while)\s*\()",
    r"(?dm)^\s*[#/]\s*(?:define|include|pragma)",
    r"(?dm)=>|->|;\s*$",
    r"(?dmU)^\s*\w+\s*=\s*\w+\s*\(",
]
#: Patterns of which each match has one of the pieces of every line: texts without them aren't searched.
_CODE_NEEDS = {0: [["```"]], 1: [["`"]], 3: [["#", "/"], ["define", "include", "pragma"]], 4: [["=>", "->", ";"]], 5: [["="], ["("]]}
#: Code points up to so many, and up to four times a text's length, are counted in a table; those of other texts are sorted.
KINDS = 128
#: Dollars for a million tokens in and out, by model; others have the fallback price.
PRICES = {
    "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4-turbo": (10.0, 30.0), "gpt-3.5-turbo": (0.5, 1.5),
    "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-haiku-20240307": (0.25, 1.25), "gemini/gemini-1.5-pro": (1.25, 5.0), "gemini/gemini-1.5-flash": (0.075, 0.3),
}
#: A line that, stripped, looks like code.
CODE_LINE = r"(?dmU)^[^\S\n]*(?:\w+[^\S\n]*=|(?:def|class|import|from) [^\S\n]*\S|\w+\([^\n]*\)[^\S\n]*$)"
#: White space of any kind, as ``(?U)\s``.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Characters of texts that a Python worker holds as strings at once; a longer text is alone.
GROUP_CHARS = 1_000_000


def one_by_one(texts: pa.Array, rule: Callable, kind: pa.DataType) -> pa.Array:
    """``rule`` of each text of an Arrow array. Strings are made one after the other and results go back to Arrow by groups of about
    ``GROUP_CHARS``, so that a batch of 10,000 long texts is never held as Python strings."""
    groups, held, chars = [], [], 0
    for x in texts:
        t = x.as_py()
        held.append(rule(t))
        chars += len(t or "")
        if chars >= GROUP_CHARS:
            groups.append(pa.array(held, kind))
            held, chars = [], 0
    groups.append(pa.array(held, kind))
    return pa.concat_arrays(groups)


def _length(x: Column) -> Column:
    return F.length(x).cast("double")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The runs of characters that aren't white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Stripped pieces between runs of ``.!?``, without blank ones."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return one_by_one(text, lambda t: None if t is None else unicodedata.normalize("NFKC", t), pa.string())


def _stable() -> str:
    """A character class of all but some code points that NFKC leaves alone wherever they stand; the few ranges keep it fast."""
    ranges: list[list[int]] = []
    for c in [*range(0x180), *range(0x400, 0x483), *range(0x2010, 0x2027), *range(0x3041, 0x3097), *range(0x4E00, 0xA000)]:
        if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


_NFKC_MAY_CHANGE = _stable()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with ``column`` in NFKC; only texts that can change are sent to Python, the others go as nulls."""
    may = F.when(F.col(column).rlike(_NFKC_MAY_CHANGE), F.col(column))
    return df.withColumn(column, F.coalesce(_nfkc(may), F.col(column)))


def normalize(text: Column) -> Column:
    """Line ends, entities, runs of newlines and of blanks; stripped. NFKC comes before (``nfkc``)."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(out, r"&(?:#\d+|[A-Za-z]+);", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def strip_boilerplate(text: Column) -> Column:
    """Without sentences that match a boilerplate rule, then without URLs and e-mail addresses."""
    kept = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: (s != "") & ~s.rlike(BOILERPLATE))
    return strip(F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"(?U)" + URL, ""), EMAIL, ""))


def chunks(text: Column, max_size: int = 4000) -> Column:
    """Paragraphs packed greedily up to ``max_size``; a longer paragraph is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        flush = (F.length(acc.cur) + F.length(p) + 2 > max_size) & (acc.cur != "")
        joined = F.when(acc.cur != "", F.concat(acc.cur, F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(flush, F.array_append(acc.out, strip(acc.cur))).otherwise(acc.out).alias("out"), F.when(flush, p).otherwise(joined).alias("cur"))

    def finish(acc: Column) -> Column:
        return F.when(strip(acc.cur) != "", F.array_append(acc.out, strip(acc.cur))).otherwise(acc.out)

    packed = F.aggregate(F.split(text, "\n\n"), start, step, finish)
    return F.when(F.length(text) <= max_size, F.array(text)).when(F.size(packed) > 0, packed).when(text.isNotNull(), F.array(F.substring(text, 1, max_size)))


def _entropy(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    if not n:
        return 0.0
    counts = np.bincount(codes) if codes.max() < max(KINDS, 4 * n) else np.unique(codes, return_counts=True)[1]
    counts = counts[counts > 0].astype(float)
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


@F.arrow_udf(DoubleType())
def char_entropy(text: pa.Array) -> pa.Array:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    return one_by_one(text, lambda t: None if t is None else _entropy(t), pa.float64())


def syllables(word: Column) -> Column:
    """Runs of vowels, less a silent e at the end, 1 at least; words of at most two characters have 1."""
    return _syllables(strip(F.lower(word)))


def _syllables(w: Column) -> Column:
    runs = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(F.length(w) <= 2, 1).otherwise(F.greatest(F.lit(1), runs - F.when(F.endswith(w, F.lit("e")) & (runs > 1), 1).otherwise(0)))


def flesch_kincaid(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Grade from counts; 0 where there is no word or sentence."""
    return F.when((n_words > 0) & (n_sentences > 0), 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59).otherwise(0.0)


def code_ratio(text: Column) -> Column:
    """The larger of the share of characters that code patterns match (overlaps count twice, 1 at most) and of lines that look like code."""

    def matched(k: int) -> Column:
        n = F.aggregate(F.regexp_extract_all(text, F.lit(CODE_PATTERNS[k]), F.lit(0)), F.lit(0), lambda s, m: s + F.length(m))
        may = [reduce(or_, [F.contains(text, F.lit(x)) for x in line]) for line in _CODE_NEEDS.get(k, [])]
        return F.when(reduce(and_, may), n).otherwise(0) if may else F.coalesce(n, F.lit(0))

    share = sum((matched(k) for k in range(len(CODE_PATTERNS))), F.lit(0)) / F.greatest(_length(text), F.lit(1.0))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.greatest(F.least(F.lit(1.0), share), F.regexp_count(text, F.lit(CODE_LINE)) / lines)


_SPACE, _STOPS = re.compile(f"[{BLANKS}]+"), re.compile("[.!?]+")
#: Bytes of words in lower case: vowels are 1, blanks 2, others 0.
_SOUNDS = bytes(1 if chr(k) in "aeiouy" else 2 * (k == 32) for k in range(256))


def _split(text: str) -> list[str]:
    """As ``words``."""
    return [w for w in _SPACE.split(text) if w]


def _syllable_total(low: list[str]) -> int:
    """The ``syllables`` of words in lower case: one for each, and one for each further run of vowels in it, less a silent e."""
    said = " ".join(low).encode() + b" "
    sounds = np.frombuffer(said.translate(_SOUNDS), np.uint8)
    vowel = sounds == 1
    starts = np.flatnonzero(vowel[1:] & ~vowel[:-1]) + 1
    if vowel[0]:
        starts = np.append(0, starts)
    ends = np.flatnonzero(sounds == 2)
    word = np.searchsorted(ends, starts)
    further = word[1:] == word[:-1]
    final = word[1:][further & np.append(word[2:] != word[1:-1], True)[: len(further)]]
    return len(low) + int(further.sum()) - int((np.frombuffer(said, np.uint8)[ends[final] - 1] == ord("e")).sum())


def _spam(text: str, tokens: list[str], low: list[str], up: list[str], pieces: list[int]) -> float:
    n = len(tokens)
    if not n:
        return 0.0
    most = max(Counter([w.strip(".,!?;:") for w in low]).values())
    long = sum([len(w) > 2 for w in tokens])
    # Most words that are as in capitals are numbers or have no capitals at all.
    capitals = sum([len(w) > 2 and w != v for w, v in compress(zip(tokens, low), map(eq, tokens, up))])
    marks = text.count("!") + text.count("?")
    total = (0.3 if most > n * 0.08 else 0.0) + (0.3 if capitals > long * 0.3 else 0.0) + (0.2 if marks > n * 0.05 else 0.0)
    return min(1.0, total + (0.2 if pieces and sum([k < 4 for k in pieces]) / len(pieces) > 0.5 else 0.0))


def _measured(text: str | None) -> tuple:
    if text is None:
        return None, None, None, None, 0.0
    # str.split takes four control characters for white space besides.
    split = _split if any(c in text for c in "\x1c\x1d\x1e\x1f") else str.split
    tokens, low = split(text), split(text.lower())
    pieces = [k for p in _STOPS.split(text) if (k := len(split(p)))]
    return len(tokens), len(pieces), _syllable_total(low), _entropy(text), _spam(text, tokens, low, split(text.upper()), pieces)


_COUNTS, _RATIOS = ("n_words", "n_sentences", "n_syllables"), ("entropy", "spam")


@F.arrow_udf(reduce(lambda s, k: s.add(k, IntegerType() if k in _COUNTS else DoubleType()), _COUNTS + _RATIOS, StructType()))
def measures(text: pa.Array) -> pa.Array:
    """The sizes of ``words`` and ``sentences``, the words' ``syllables``, the entropy of characters, and spam: penalties for a
    repeated word, capitals, exclamation and question marks, and short sentences; 1 at most."""
    return one_by_one(text, _measured, pa.struct([(k, pa.int32()) for k in _COUNTS] + [(k, pa.float64()) for k in _RATIOS]))


def spam_score(text: Column, tokens: Column | None = None, pieces: Column | None = None) -> Column:
    """The spam of ``measures``. Words and sentences are the text's own; they needn't be given."""
    return measures(text)["spam"]


def quality(n_chars: Column, n_words: Column, n_sentences: Column, grade: Column, entropy: Column, code: Column, spam: Column) -> Column:
    """The weighted score of six curves, 0 to 1, rounded to 3 places; 0 for fewer than 50 characters or no words or sentences."""
    chars, per = n_chars.cast("double"), n_words / n_sentences
    length = F.when(chars < 200, chars / 200 * 0.5).when(chars < 500, 0.5 + (chars - 200) / 300 * 0.3).when(chars < 5000, 0.8 + (chars - 500) / 4500 * 0.2).otherwise(1.0)
    sentence = F.when(per < 5, per / 5 * 0.5).when(per > 40, F.greatest(F.lit(0.3), 1.0 - (per - 40) / 40)).otherwise(0.7 + (per - 5) / 35 * 0.3)
    reading = F.when(grade < 3, 0.4).when(grade < 8, 0.7 + (grade - 3) / 5 * 0.3).when(grade < 14, 1.0).when(grade < 20, F.greatest(F.lit(0.5), 1.0 - (grade - 14) / 6 * 0.5)).otherwise(0.3)
    chaos = F.when(entropy < 3.0, entropy / 3.0 * 0.5).when(entropy < 4.5, 0.5 + (entropy - 3.0) / 1.5 * 0.5).otherwise(1.0)
    total = length * 0.15 + sentence * 0.20 + reading * 0.20 + chaos * 0.20 + (1.0 - F.least(F.lit(1.0), code * 1.5)) * 0.15 + (1.0 - spam) * 0.10
    return F.when((n_chars >= 50) & (n_words > 0) & (n_sentences > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)).otherwise(0.0)


def detect_language(text: Column, listed: list[str] = ENGLISH) -> Column:
    """'en', 'non-ascii' or 'unknown', by the share of common English words among the first 500 of plain letters."""
    n = _length(text)
    foreign = n - _length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))
    plain = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]+(?![\p{L}\p{N}_])"), F.lit(0)), 1, 500)
    english = let(plain, lambda tokens: F.size(F.filter(tokens, lambda w: w.isin(listed))) > F.size(tokens) * F.lit(0.25))
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, "unknown").when(foreign / n > 0.3, "non-ascii").when(english, "en").otherwise("unknown")


def normalize_answer(text: Column) -> Column:
    """Lower case, single blanks, without blanks and ``.!?`` at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " "), r"^[ .!?]+|[ .!?]+$", "")


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block, or the stripped text; an open fence without a new line is kept as it is."""
    inside = lambda t: F.substr(t, F.instr(t, "\n") + 1)
    closed = lambda t: strip(F.regexp_replace(inside(t), r"(?s)```(?:(?!```).)*$", ""))
    return let(strip(text), lambda t: F.when(F.startswith(t, F.lit("```")) & F.contains(t, F.lit("\n")), closed(t)).otherwise(t))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def fallback_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """The price in dollars where a model's own is unknown."""
    return tokens_in / 1000 * 0.01 + tokens_out / 1000 * 0.03


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """The price of a call in dollars by its model's entry in ``prices``, the fallback price where it has none."""
    out = fallback_cost(tokens_in, tokens_out)
    for name, (into, back) in prices.items():
        out = F.when(model == name, tokens_in / 1_000_000 * into + tokens_out / 1_000_000 * back).otherwise(out)
    return out


def format_cost(cost: Column) -> Column:
    return F.when(cost < 0.01, F.format_string("$%.4f", F.round(F.round(cost, 6), 4))).otherwise(F.format_string("$%.2f", F.round(F.round(cost, 6), 2)))


def file_stem(topic: Column) -> Column:
    return F.regexp_replace(topic, r"[^\p{L}\p{N}_-]", "_")


def first_number(text: Column) -> Column:
    """The first number or fraction of a text, else the stripped text."""
    found = F.regexp_extract(text, r"[-+]?\d*\.?\d+(?:/\d+)?", 0)
    return F.when(found != "", found).otherwise(strip(text))
