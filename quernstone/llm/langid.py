"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed character trigrams, estimated here from documents that carry a language tag;
one more component, uniform over the buckets, stands for anything else. Expectation-maximisation estimates the
proportions of a document's trigrams that each component explains. Sets of languages are compared by penalised likelihood,
log L - penalty * (size of the set - 1) * log(n) / 2 with n trigrams.

The search begins with the best single component. In each step the component whose addition gains most joins, if it pays
for itself; components under ``min_share`` then leave, as does one without which the penalised likelihood is higher; it ends
where no addition and no removal pays, so the set is a local optimum (``tests/llm`` compare it with all sets). With the
gradients g_j = mean of p_j / mixture over the trigrams, log L is concave, so no mixture of the set and j gains more than
n log max g: components that can't pay by this bound are not tried, which changes no result, and most texts are settled by it
without any rounds. Rounds end when the same bound says that a set's likelihood is within ``TOLERANCE`` of its maximum. A set
has at most 1 / ``min_share`` languages, so a text costs at most some tens of rounds of fits for each known language.
Sums are in double precision: results don't depend on how rows are batched but for the last bits, which rounding hides.

The model is fitted on a bounded sample of tagged documents (``per_language`` of each tag, chosen by a hash of doc_id), on every tag that there is;
everything else covers whole texts of all rows.

Defined results: a null or empty text, or one without letters (digits, punctuation, emoji), has no language, an empty set and
keep = false; ties in the likelihood go to the smaller set, then to the first language by name; without tagged documents nothing
can be told apart, every text with a letter has the set ['unknown'] and is kept; very long texts are counted whole; repeated rows
get equal results; an empty table gives an empty result; extra columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import code_points, map_rows, text_groups, unit_hash

BUCKETS = 4096
UNKNOWN = "unknown"
#: Documents of each language tag that the model is fitted on, about.
PER_LANGUAGE = 1000
PENALTY, MIN_SHARE = 8.0, 0.1
#: How far below its maximum a set's log likelihood may be, and the rounds after which that is taken as it is.
TOLERANCE, ROUNDS = 0.01, 2000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def trigram_counts(texts: list) -> np.ndarray:
    """[n, BUCKETS] counts of trigrams around each letter; whatever isn't a letter is a boundary."""
    codes, doc = code_points([t.lower() if t else "" for t in texts])
    c = _letters()[codes]
    mid = np.flatnonzero(c[:-1])  # the last code is a boundary
    before = np.where(mid > 0, c[mid - 1], 0).astype(np.uint32)
    h = (before * np.uint32(0x9E3779B1)) ^ (c[mid] * np.uint32(0x85EBCA6B)) ^ (c[mid + 1] * np.uint32(0xC2B2AE35))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    return np.bincount(doc[mid] * BUCKETS + h, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float64)


def _mixture(counts: np.ndarray, p: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Proportions of the rows of p that explain ``counts`` [buckets] best, and the log likelihood."""
    n = counts.sum()
    theta = np.full(len(p), 1 / len(p))
    for _ in range(rounds if len(p) > 1 else 0):
        gradient = p @ (counts / (theta @ p)) / n
        if n * np.log(gradient.max()) <= tolerance:
            break
        theta = theta * gradient
    return theta, float(counts @ np.log(theta @ p))


class Model:
    """Language names and their bucket distributions; the last component is UNKNOWN."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = [*names, UNKNOWN]
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS) if len(names) else np.zeros((0, BUCKETS))
        self.p = np.vstack([p, np.full((1, BUCKETS), 1 / BUCKETS)])

    def infer(self, counts: np.ndarray, penalty: float = PENALTY, min_share: float = MIN_SHARE) -> tuple[np.ndarray, np.ndarray]:
        """Shares [n, k] over the chosen sets (0 elsewhere) and the mean log likelihood of a trigram."""
        rows, n = np.arange(len(counts)), counts.sum(1)
        single = counts @ np.log(self.p).T
        best = single.argmax(1)
        value = single[rows, best]
        share = np.zeros((len(best), len(self.names)))
        share[rows, best] = n > 0
        if len(self.names) > 1:
            cost = penalty * np.log(np.maximum(n, 2)) / 2
            gradient = (counts / self.p[best]) @ self.p.T / np.maximum(n, 1)[:, None]
            for r in np.flatnonzero(n * np.log(np.maximum(gradient.max(1), 1)) > cost):
                at = np.flatnonzero(counts[r])
                group, theta, value[r] = self._grow(counts[r, at], self.p[:, at], int(best[r]), float(value[r]), float(cost[r]), min_share)
                share[r] = 0
                share[r, group] = theta
        return share, value / np.maximum(n, 1)

    @staticmethod
    def _grow(counts: np.ndarray, p: np.ndarray, first: int, value: float, cost: float, min_share: float) -> tuple[list[int], np.ndarray, float]:
        """The set that no addition and no removal improves, its shares and log likelihood; begins with ``first``."""
        n = counts.sum()

        def fitted(group: list[int]) -> tuple[float, list[int], np.ndarray, float]:
            """Without the components under ``min_share``: (penalised likelihood, set, shares, likelihood)."""
            while True:
                theta, ll = _mixture(counts, p[group])
                if len(group) == 1 or theta.min() >= min_share:
                    return ll - cost * (len(group) - 1), group, theta, ll
                group = [g for k, g in enumerate(group) if k != int(theta.argmin())]

        now = (value, [first], np.ones(1), value)
        while True:
            _, group, theta, ll = now
            gradient = p @ (counts / (theta @ p[group])) / n
            inside = gradient[group].max()
            found = now
            for j in np.argsort(-gradient, kind="stable").tolist():
                if j in group:
                    continue
                # No mixture of the set and j exceeds the likelihood by more than this.
                if n * np.log(max(gradient[j], inside)) <= max(cost, found[0] - now[0] + cost):
                    break
                tried = fitted(sorted([*group, j]))
                if tried[0] > found[0] + 1e-6:
                    found = tried
            if found is now:
                for g in group if len(group) > 1 else ():
                    tried = fitted([x for x in group if x != g])
                    if tried[0] > found[0] + 1e-6:
                        found = tried
            if found is now:
                return group, theta, ll
            now = found


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 1) -> Model:
    tagged = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    rates = tagged.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("rate"))
    sample = tagged.join(F.broadcast(rates), "lang").where(unit_hash(F.coalesce("doc_id", F.lit(0)), seed=seed) < F.col("rate")).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, texts in f.groupby("lang", sort=False)["text"]:
                texts = list(texts)
                for a, b in text_groups(texts):
                    total[lang] = total.get(lang, 0) + trigram_counts(texts[a:b]).sum(0, dtype=np.float64)
        if total:  # a task may have no rows
            yield pd.DataFrame({"lang": list(total), "counts": [x.tobytes() for x in total.values()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, counts in zip(f["lang"], f["counts"]):
                total[lang] = total.get(lang, 0) + np.frombuffer(counts, np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "counts": [x.tobytes() for x in total.values()]})

    schema = "lang string, counts binary"
    found = {r["lang"]: np.frombuffer(r["counts"], np.float64) for r in sample.mapInPandas(count, schema).repartition("lang").mapInPandas(add, schema).toLocalIterator()}
    names = sorted(found)
    return Model(names, np.array([found[x] for x in names]).reshape(len(names), BUCKETS))


def _infer_texts(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    share, score, grams = [np.zeros((0, len(model.names)))], [np.zeros(0)], [np.zeros(0)]
    for a, b in text_groups(texts):
        for c in range(a, b, 256):
            counts = trigram_counts(texts[c : min(b, c + 256)])
            s, v = model.infer(counts)
            share.append(s)
            score.append(v)
            grams.append(counts.sum(1))
    return np.concatenate(share), np.concatenate(score), np.concatenate(grams)


def _kept(model: Model, share: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return (grams > 0) & ((share[:, -1] <= 0.5) | (len(model.names) == 1))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, language, languages, shares, trigrams, log_likelihood, keep): languages by share, largest first."""
    model = model or fit(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            share, score, grams = _infer_texts(model, [t if isinstance(t, str) else "" for t in f["text"]])
            order = np.argsort(-share, axis=1, kind="stable")
            sets = [[k for k in o if s[k] > 0] for o, s in zip(order.tolist(), share)]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "language": [model.names[s[0]] if s else None for s in sets],
                "languages": [[model.names[k] for k in s] for s in sets], "shares": [[round(float(v[k]), 4) for k in s] for s, v in zip(sets, share)],
                "trigrams": grams.astype(np.int64), "log_likelihood": score.round(6), "keep": _kept(model, share, grams),
            })

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, language string, languages array<string>, shares array<double>, trigrams long, log_likelihood double, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the documents in which no known language is found."""
    model = model or fit(docs)

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        share, _, grams = _infer_texts(model, [t if isinstance(t, str) else "" for t in text])
        return pd.Series(_kept(model, share, grams))

    return docs.where(keep(docs["text"]))
