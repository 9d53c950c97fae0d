"""URL filter: gradient-boosted trees on lexical features.

Features: lengths of URL, host and path, path depth, ratio of digits, entropy of the host's and of all characters, hyphens
and dots of the host, longest path part, parameters, and statistics of the host's suffix (its last two labels): how many
URLs, distinct hosts and URLs a host it has. Suffix statistics cover all URLs. Suffixes with more than a ``HOT``-th of all URLs,
of which there are fewer than ``HOT``, are broadcast, so that a hot suffix is never one task's; the others are joined by suffix, in as
many tasks as their number asks for; URLs without a host aren't joined at all.

Labelled URLs are a table (url, bad). ``seed_labels`` makes one where there is none, as there is none among the test tables: a URL
is bad when its host's parts hold a term of a block list, and good otherwise. The trees see lexical features only, so what they learn
carries over to hosts that the list doesn't name; ``tests/llm`` measures this on hosts held out. They are fitted on the driver on a
bounded sample (``max_labelled``, by a hash of the URL); scoring covers every row.

Defined results: a null or empty URL, or one that has no host, gets probability null and is kept; very long URLs are read whole;
equal URLs, repeated rows too, get equal results; a probability of exactly ``BAD`` is bad, and of splits or cuts that gain the same
the first is taken; without labels of both kinds every URL gets the one label's rate, and 0.5 without any; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import checkpointed, map_rows, unit_hash

MAX_LABELLED, TREES, DEPTH, RATE, BINS, MIN_LEAF, BAD = 20_000, 40, 3, 0.2, 32, 5, 0.5
#: The share of all URLs over which a suffix is hot is 1 / HOT; URLs of other suffixes that a task joins, about.
HOT, TASK_URLS = 1000, 200_000
SEED_TERMS = ("casino", "bets", "ads", "spam", "pills", "adult", "porn", "xxx", "viagra", "warez")
LEXICAL = ["url_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "host_entropy", "host_hyphens", "host_labels", "longest_part", "parameters", "secure"]
SUFFIX = ["suffix_urls", "suffix_hosts", "suffix_urls_per_host"]


def host_of(url: Column) -> Column:
    """Lower-case host, null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / len(s)
    return round(float(-(n * np.log2(n)).sum()), 12)  # equal histograms give equal values


def lexical(url: str, host: str) -> list[float]:
    rest = url.split("://", 1)[-1]
    path = re.split(r"[?#]", rest[rest.find("/") :] if "/" in rest else "", maxsplit=1)[0]
    query = url.split("#", 1)[0].partition("?")[2]
    parts = [p for p in path.split("/") if p]
    digits = sum(c.isdigit() for c in url)
    return [len(url), len(host), len(path), len(parts), digits / len(url), _entropy(url), _entropy(host), host.count("-"), host.count(".") + 1, max(map(len, parts), default=0), sum(1 for p in query.split("&") if p), float(url[:6].lower() == "https:")]


class Trees:
    """Boosted regression trees for the logistic loss; each tree is arrays (feature, cut, value) in heap order."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.trees = base, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                right = np.zeros(len(x), bool)
                right[inner] = x[inner, feature[node[inner]]] > cut[node[inner]]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Second-order boosting over quantile bins."""
    n = len(y)
    if not n:
        return Trees(0.0, [])
    p = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
    model = Trees(float(np.log(p / (1 - p))), [])
    if y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    cuts = [c if len(c) > 2 else np.unique(x[:, j])[:-1] if len(np.unique(x[:, j])) <= BINS else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(n, model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value, node = np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(n, np.int64)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            G, H = g[rows].sum(), h[rows].sum()
            value[at] = rate * G / (H + 1)
            if at >= 2**DEPTH - 1 or len(rows) < 2 * MIN_LEAF:
                continue
            best = (1e-6, -1, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = np.round(gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1), 8)  # sums of one set in another order are equal
                gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[at], cut[at] = best[1], cuts[best[1]][best[2]]
                node[rows] = 2 * at + 1 + (binned[rows, best[1]] > best[2])
        model.trees.append((feature, cut, value))
        score += value[node]
    return model


def seed_labels(pages: DataFrame, terms: tuple[str, ...] = SEED_TERMS) -> DataFrame:
    """(url, bad) of all URLs with a host."""
    listed = F.arrays_overlap(F.split(host_of(F.col("url")), r"[.\-_]"), F.array(*map(F.lit, terms)))
    return pages.select("url", listed.cast("int").alias("bad")).where("bad IS NOT NULL")


def _hosts(pages: DataFrame, id_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("id"), "url").withColumn("host", host_of(F.col("url"))).withColumn("suffix", suffix_of(F.col("host")))


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """(suffix, urls, the statistics) over all URLs, checkpointed."""
    hosts = pages.select("url").withColumn("host", host_of(F.col("url"))).where("host IS NOT NULL").select("host", suffix_of(F.col("host")).alias("suffix"))
    stats = hosts.groupBy("suffix", "host").agg(F.count("*").alias("n")).groupBy("suffix").agg(F.sum("n").alias("urls"), F.count("*").alias("hosts"))
    return checkpointed(stats.select("suffix", "urls", F.log1p("urls").alias("suffix_urls"), F.log1p("hosts").alias("suffix_hosts"), F.log1p(F.col("urls") / F.col("hosts")).alias("suffix_urls_per_host")))


def with_suffix(pages: DataFrame, id_col: str, stats: DataFrame | None = None) -> DataFrame:
    """(id, url, host, the statistics of the host's suffix)."""
    hosts = _hosts(pages, id_col)
    stats = suffix_statistics(pages) if stats is None else stats
    total = stats.agg(F.sum("urls")).first()[0] or 0
    is_hot = F.col("urls") * HOT > total
    hot, cold = stats.where(is_hot).drop("urls"), stats.where(~is_hot).drop("urls")
    # Fewer than HOT suffixes can have more than a HOT-th of the URLs each.
    near = hosts.join(F.broadcast(hot), "suffix")
    urls = stats.where(~is_hot).agg(F.sum("urls")).first()[0] or 0
    tasks = max(1, -(-urls // TASK_URLS), pages.sparkSession.sparkContext.defaultParallelism if urls > TASK_URLS // 20 else 1)
    others = hosts.where("suffix IS NOT NULL").join(F.broadcast(hot.select("suffix")), "suffix", "left_anti")
    far = others.repartition(tasks, "suffix").join(cold.repartition(tasks, "suffix").hint("shuffle_hash"), "suffix")
    none = hosts.where("suffix IS NULL").select("*", *[F.lit(None).cast("double").alias(c) for c in SUFFIX])
    columns = ["id", "url", "host", *SUFFIX]
    found = near.select(columns).unionByName(none.select(columns))
    return found.unionByName(far.select(columns)) if urls else found


def _matrix(f: pd.DataFrame) -> np.ndarray:
    return np.hstack([np.array([lexical(u, h) for u, h in zip(f["url"], f["host"])]).reshape(len(f), len(LEXICAL)), f[SUFFIX].to_numpy(float)])


def fit(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", max_labelled: int = MAX_LABELLED, seed: int = 11, stats: DataFrame | None = None) -> Trees:
    known = labels.where("url IS NOT NULL AND bad IS NOT NULL").groupBy("url").agg(F.max("bad").alias("bad"))
    sample = known.orderBy(unit_hash(F.col("url"), seed=seed), "url").limit(max_labelled)
    # The sample's size is bounded by max_labelled; each of its URLs is left once before anything is gathered.
    own = checkpointed(pages.select("url").join(F.broadcast(sample), "url").groupBy("url").agg(F.max("bad").alias("bad")))
    stats = suffix_statistics(pages) if stats is None else stats
    found = _hosts(own, "bad").withColumnRenamed("id", "bad").where("host IS NOT NULL")
    suffixes = found.select("suffix").distinct()  # no more than the sample's URLs
    rows = found.join(F.broadcast(stats.join(F.broadcast(suffixes), "suffix").drop("urls")), "suffix").select("url", "host", *SUFFIX, "bad").toPandas().sort_values("url", kind="stable")
    return fit_trees(_matrix(rows), rows["bad"].to_numpy(float))


def score(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", model: Trees | None = None) -> DataFrame:
    """(page_id, url, probability, bad, keep)."""
    stats = suffix_statistics(pages)
    model = model or fit(pages, seed_labels(pages) if labels is None else labels, id_col, stats=stats)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = np.full(len(f), np.nan)
            ok = f["host"].notna().to_numpy()
            if ok.any():
                p[ok] = model.probability(_matrix(f[ok])).round(6)
            yield pd.DataFrame({"id": f["id"], "url": f["url"], "probability": pd.Series(p).where(~np.isnan(p), None), "bad": p >= BAD, "keep": ~(p >= BAD)})

    return map_rows(with_suffix(pages, id_col, stats), run, "id long, url string, probability double, bad boolean, keep boolean", "id").withColumnRenamed("id", id_col)
