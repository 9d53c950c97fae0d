"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - cut_k): the weights of the sparse features are shared by all thresholds, the cuts are
ordered, and the output is the expected grade, the sum over k of P(grade > k). Features are which words a text has and
which four-letter beginnings its longer words have.

Grades to learn are a column ``grade`` (0, 1, 2, ...) where labels have one. Labels that hold only toxic 0 or 1 give 0 for a document
that isn't labelled toxic and 1 or 2 for one that is, 2 by proxy: where it has more distinct terms of the lexicon of the other half
of the labelled documents than the median of the toxic documents of its own half. So no document is graded by terms that its own
label helped to choose, but the proxy is a statistic of texts, not a judgement; labels with grades are to be preferred.
Indicative terms are those that occur in significantly more of the documents of grade 1 or more (a z-test on document
frequencies, ``MIN_Z``; of a half, they are its lexicon); only they are features, with weights of at least 0, so that words which say nothing add no noise to long
texts. Near copies in the sample (any of three min-hashes of word triples in common) count once, else the rare words of one much
copied toxic document would pass for indicative.

The model is fitted on a bounded sample of the labelled documents (``max_labelled``, by a hash of the id; of an id's texts the one
of least hash). Terms are found and document frequencies counted in Spark; the driver gets three hashes for each sampled document, and
the indicative terms of each. Scoring covers whole texts of all rows.

Defined results: a null or empty text has no features and is scored like any other clean text; very long texts are scored whole, a
term counts once however often it occurs; labels with null fields are ignored, of several labels for an id the highest grade counts;
without labels of both kinds nothing is toxic (severity 0); a severity of exactly ``TOXIC`` is toxic; repeated rows, and any that
tie in their terms, get equal results; an empty table gives an empty result; extra columns are ignored by ``score`` and kept by
``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import checkpointed, map_rows, unit_hash

MAX_LABELLED, MIN_Z, GRADES, L2, ROUNDS = 12_000, 5.0, 3, 0.3, 400
#: A document is toxic where its expected severity is at least this.
TOXIC = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_PREFIX, _LONG = 4, 5


def terms(text: str | None) -> set[str]:
    """The distinct words of a text, and the beginnings of its longer ones, marked by a trailing dash."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:_PREFIX] + "-" for w in words if len(w) >= _LONG}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights by term and the ordered cuts."""

    def __init__(self, weights: dict[str, float] | None = None, cuts: np.ndarray | None = None):
        self.weights, self.cuts = weights or {}, np.zeros(0) if cuts is None else cuts
        self.words = {t: w for t, w in self.weights.items() if not t.endswith("-")}
        self.prefixes = {t[:-1]: w for t, w in self.weights.items() if t.endswith("-")}

    def _linear(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        words = set(_WORD.findall(text.lower()))
        hits = [self.words[w] for w in words & self.words.keys()]
        starts = {w[:_PREFIX] for w in words if len(w) >= _LONG} if self.prefixes else set()
        hits += [self.prefixes[p] for p in starts & self.prefixes.keys()]
        return float(sum(sorted(hits))), len(hits)

    def severity(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected grade, most likely grade and number of indicative terms."""
        found = [self._linear(t if isinstance(t, str) else None) for t in texts]
        hits = np.array([n for _, n in found], np.int64)
        if not len(self.cuts):
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32), hits
        above = _sigmoid(np.array([x for x, _ in found])[:, None] - self.cuts[None, :])
        edges = np.hstack([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))])
        return above.sum(1), (edges[:, :-1] - edges[:, 1:]).argmax(1).astype(np.int32), hits


def fit_grades(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int = GRADES, l2: float = L2, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the proportional-odds model for binary features ``rows``, by full-batch Adam."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows) if len(row) else np.zeros(0, np.int64)
    above = (grades[:, None] > np.arange(n_grades - 1)).astype(float)
    share = np.clip(above.mean(0), 0.5 / n, 1 - 0.5 / n)
    base = np.log((1 - share) / share)
    x = np.concatenate([np.zeros(n_features), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, first, gaps = x[:n_features], x[n_features], np.exp(x[n_features + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[col], n)
        s = np.hstack([np.ones((n, 1)), _sigmoid(z[:, None] - cuts), np.zeros((n, 1))])
        at = np.arange(n)
        p = np.maximum(s[at, grades] - s[at, grades + 1], 1e-9)
        slope = s * (1 - s)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        dcut = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):  # cut k is the lower edge of grade k + 1 and the upper edge of grade k
            dcut[k] = (np.where(grades == k + 1, slope[:, k + 1], 0) / p).sum() / n - (np.where(grades == k, slope[:, k + 1], 0) / p).sum() / n
        g = np.concatenate([np.bincount(col, dz[row], n_features) + l2 * w / n, [dcut.sum()], gaps * np.array([dcut[k + 1 :].sum() for k in range(n_grades - 2)])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x[:n_features] = np.maximum(x[:n_features], 0)
    return x[:n_features], x[n_features] + np.concatenate([[0], np.cumsum(np.exp(x[n_features + 1 :]))])


_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def copy_hashes(text: str) -> list[int]:
    """Three min-hashes of the word triples of a text, or of its words if there are fewer."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in _WORD.findall(text.lower())] or [0], np.uint64)
    if len(h) > 2:
        h = h[:-2] * np.uint64(31) ^ h[1:-1] * np.uint64(37) ^ h[2:] * np.uint64(41)
    mixed = (h[None, :] ^ _SALTS[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed ^ mixed >> np.uint64(33)).min(1).view(np.int64).tolist()


def without_copies(hashes: list) -> list[int]:
    """Positions of the documents that share none of their hashes with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, own in enumerate(hashes):
        keys = set(enumerate(own))
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the usable labels, one row for each id; 1 for toxic where there is no column ``grade``."""
    grade = F.col("grade").cast("int") if "grade" in labels.columns else (F.col("toxic") > 0).cast("int")
    return labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def proxy_grades(toxic: np.ndarray, half: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades from toxic 0 or 1, the half of each document and how many terms of the other half's lexicon it has."""
    grade = toxic.astype(np.int64)
    for h in (0, 1):
        own = (half == h) & (toxic > 0)
        if own.any():
            grade[own] += hits[own] > np.median(hits[own])
    return grade


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_z: float = MIN_Z, seed: int = 3) -> Model:
    sample = graded(labels).orderBy(unit_hash(F.col("doc_id"), seed=seed), "doc_id").limit(max_labelled)
    # The sample's size is bounded by max_labelled; one text for each of its ids is left before anything else happens.
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))

    @F.pandas_udf("struct<hashes: array<long>, terms: array<string>>")
    def seen(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"hashes": [copy_hashes(t) for t in text], "terms": [sorted(terms(t)) for t in text]})

    half = (unit_hash(F.col("doc_id"), seed=seed + 1) < 0.5).cast("int")
    found = checkpointed(one.select("doc_id", "grade", half.alias("half"), seen("least.text").alias("seen")).select("doc_id", "grade", "half", "seen.*"))
    every = sorted(found.select("doc_id", "grade", "half", "hashes").collect())
    single = [every[k] for k in without_copies([r["hashes"] for r in every])]
    #: Documents by half, clean and toxic.
    n = np.zeros((2, 2), np.int64)
    for r in single:
        n[r["half"], int(r["grade"] > 0)] += 1
    if not n.sum(0).all():
        return Model()
    kept = found.join(F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r in single], "doc_id long")), "doc_id")
    cells = [F.sum(((F.col("half") == h) & ((F.col("grade") > 0) == bool(y))).cast("long")).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]

    def indicative(a, b, n1: int, n0: int):
        if not n1 or not n0:
            return F.lit(False)
        pooled = (a + b + 1) / (n1 + n0 + 2)
        return (a > 1) & ((a / n1 - b / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)) >= min_z)

    c = {x: F.col(f"n{x}") for x in ("00", "01", "10", "11")}
    tests = [indicative(c["01"] + c["11"], c["00"] + c["10"], *map(int, n.sum(0)[::-1])), *(indicative(c[f"{h}1"], c[f"{h}0"], int(n[h, 1]), int(n[h, 0])) for h in (0, 1))]
    counted = kept.withColumn("term", F.explode("terms")).groupBy("term").agg(*cells).select("term", *[t.alias(x) for t, x in zip(tests, ("feature", "lexicon0", "lexicon1"))])
    chosen = sorted(counted.where("feature OR lexicon0 OR lexicon1").collect())
    number = {r["term"]: k for k, r in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def numbers(found: pd.Series) -> pd.Series:
        return pd.Series([sorted(number[t] for t in ts if t in number) for ts in found])

    rows = sorted(kept.select("doc_id", "grade", "half", numbers("terms").alias("terms")).collect())
    grades = np.array([r["grade"] for r in rows])
    if "grade" not in labels.columns:
        halves = np.array([r["half"] for r in rows])
        grades = proxy_grades(grades, halves, np.array([sum(chosen[k]["lexicon0" if r["half"] else "lexicon1"] for k in r["terms"]) for r in rows]))
    features = [k for k, r in enumerate(chosen) if r["feature"]]
    place = np.full(len(chosen) + 1, -1)
    place[features] = np.arange(len(features))
    own = [place[np.array(r["terms"], np.int64)] for r in rows]
    weights, cuts = fit_grades([x[x >= 0] for x in own], grades, len(features), max(GRADES, int(grades.max()) + 1))
    return Model({chosen[k]["term"]: float(weights[place[k]]) for k in features}, cuts)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, severity, grade, indicative_terms, toxic)."""
    model = model or fit(docs, labels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            severity, grade, hits = model.severity(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "severity": severity.round(6), "grade": grade, "indicative_terms": hits, "toxic": severity >= TOXIC})

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, severity double, grade int, indicative_terms long, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the toxic documents."""
    model = model or fit(docs, labels)

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        return pd.Series(model.severity(text.tolist())[0] < TOXIC)

    return docs.where(keep(docs["text"]))
