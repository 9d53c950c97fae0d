import math
import random
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest

from quernstone.llm import urls as U
from quernstone.llm._common import ship


def pages(n, seed):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        bad = rnd.random() < 0.3
        word = lambda a, b: "".join(rnd.choices("abcdefghijklmnoprstu", k=rnd.randint(a, b)))
        if bad:
            host = f"{word(5, 9)}-{word(4, 8)}-{rnd.randint(10, 999)}.{word(3, 5)}{rnd.randint(0, 9)}.info"
            url = f"http://{host}/{rnd.randint(10**6, 10**9)}/?id={rnd.randint(0, 10**6)}&ref={word(8, 12)}&aff={rnd.randint(0, 999)}"
        else:
            url = f"https://www.{word(4, 8)}.org/{word(3, 8)}/{word(4, 12)}"
        out.append((k, url, int(bad)))
    return out


def test_hosts_held_out(spark):
    ship(spark)
    rows = pages(1200, 1)
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    labels = df.where("page_id < 800").select("url", "bad")
    got = {r["page_id"]: r["bad"] for r in U.score(df.select("page_id", "url"), labels).collect()}
    held = [(got[k], bool(bad)) for k, _, bad in rows if k >= 800]
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_trees_match_a_walk_by_hand():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = U.fit_trees(x, y)
    assert ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.95
    for row in x[:50]:
        total = model.base
        for feature, cut, value in model.trees:
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node]
        assert abs(total - model.raw(row[None])[0]) < 1e-9


def test_features():
    url = "https://Ab.cd-e.example.org/x/yyyy/12?a=1&b=&&c#f?z=1"
    f = dict(zip(U.LEXICAL, U.lexical(url, "ab.cd-e.example.org")))
    assert (f["depth"], f["parameters"], f["longest_part"], f["host_labels"], f["host_hyphens"], f["secure"]) == (3, 3, 4, 4, 1, 1.0)
    assert U._entropy("aabb") == 1.0 and U._entropy("") == 0.0


def test_suffix_statistics_cover_all_urls(spark):
    rows = [(1, "http://a.x.com/1"), (2, "http://a.x.com/2"), (3, "http://b.x.com/"), (4, "http://y.org/")]
    got = {r["id"]: r for r in U.with_suffix(spark.createDataFrame(rows, "page_id long, url string"), "page_id").collect()}
    assert abs(got[1]["suffix_urls"] - np.log(4)) < 1e-9 and abs(got[3]["suffix_hosts"] - np.log(3)) < 1e-9 and abs(got[4]["suffix_urls_per_host"] - np.log(2)) < 1e-9


def plain_features(url, stats):
    parts = urlsplit(url)
    host = parts.hostname
    entropy = lambda s: round(-sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()), 12) if s else 0.0
    path = [p for p in parts.path.split("/") if p]
    n = [len(url), len(host), len(parts.path), len(path), sum(c.isdigit() for c in url) / len(url), entropy(url), entropy(host), host.count("-"), host.count(".") + 1, max(map(len, path), default=0), sum(1 for p in parts.query.split("&") if p), float(parts.scheme == "https")]
    urls, hosts = stats[".".join(host.split(".")[-2:])]
    return [*n, math.log1p(urls), math.log1p(hosts), math.log1p(urls / hosts)]


def plain_trees(x, y):
    """Second-order boosting with every sum taken anew for each cut."""
    n = len(y)
    p = min(max(y.mean(), 1 / (n + 2)), 1 - 1 / (n + 2))
    base = math.log(p / (1 - p))
    cuts = []
    for j in range(x.shape[1]):
        found = sorted({float(np.quantile(x[:, j], q, method="lower")) for q in np.linspace(0, 1, U.BINS + 1)[1:-1]})
        every = sorted(set(x[:, j].tolist()))
        cuts.append(every[:-1] if len(found) <= 2 and len(every) <= U.BINS else found)
    score = [base] * n
    for _ in range(U.TREES):
        q = [1 / (1 + math.exp(-s)) for s in score]
        g, h = np.array(y - q), np.array([a * (1 - a) for a in q])
        value = {}

        def grow(rows, depth):
            G, H = g[rows].sum(), h[rows].sum()
            if depth < U.DEPTH and len(rows) >= 2 * U.MIN_LEAF:
                best = (1e-6, None)
                for j, own in enumerate(cuts):
                    of = (0.0, None)
                    for c in own:
                        left = rows[x[rows, j] <= c]
                        if min(len(left), len(rows) - len(left)) < U.MIN_LEAF:
                            continue
                        a, b = g[left].sum(), h[left].sum()
                        gain = round(a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1), 8)
                        if gain > of[0]:
                            of = (gain, (j, c))
                    if of[0] > best[0]:
                        best = of
                if best[1]:
                    j, c = best[1]
                    grow(rows[x[rows, j] <= c], depth + 1)
                    grow(rows[x[rows, j] > c], depth + 1)
                    return
            for r in rows:
                value[int(r)] = U.RATE * G / (H + 1)

        grow(np.arange(n), 0)
        score = [s + value[k] for k, s in enumerate(score)]
    return [1 / (1 + math.exp(-s)) for s in score]


def test_query_matches_brute_force(spark):
    """Labels, features, suffix statistics, fit and scores of every page from their definitions."""
    from quernstone.llm.queries import queries
    from tests.conftest import SF

    pages_ = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts = {r["url"]: urlsplit(r["url"]).hostname for r in pages_}
    suffix = lambda u: ".".join(hosts[u].split(".")[-2:])
    urls, per = Counter(suffix(r["url"]) for r in pages_), {}
    for u, h in hosts.items():
        per.setdefault(suffix(u), set()).add(h)
    stats = {s: (n, len(per[s])) for s, n in urls.items()}
    every = sorted(hosts)
    assert len(every) <= U.MAX_LABELLED
    x = np.array([plain_features(u, stats) for u in every])
    y = np.array([float(any(t in U.SEED_TERMS for t in hosts[u].replace("-", ".").replace("_", ".").split("."))) for u in every])
    assert 0 < y.sum() < len(y)
    want = dict(zip(every, plain_trees(x, y)))
    got = queries()["op1_url_filter"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r["page_id"] for r in pages_)
    for r in got:
        assert r["probability"] == pytest.approx(want[r["url"]], abs=1e-4) and r["bad"] == (r["probability"] >= U.BAD) != r["keep"]


def test_rare_suffixes_are_joined_in_tasks(spark, monkeypatch):
    """Hot suffixes, broadcast, and all others, shuffled, have the statistics of a plain count."""
    ship(spark)
    monkeypatch.setattr(U, "HOT", 10)
    rows = [(k, f"http://h{k % 5}.hot.com/{k}") for k in range(60)] + [(100 + k, f"http://h{k}.s{k % 40}.org/") for k in range(120)] + [(300, None), (301, "no host")]
    found = U.with_suffix(spark.createDataFrame(rows, "page_id long, url string"), "page_id")
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(rows) and got[300]["suffix_urls"] is None and got[301]["host"] is None
    assert got[7]["suffix_urls"] == pytest.approx(math.log1p(60)) and got[7]["suffix_hosts"] == pytest.approx(math.log1p(5))
    assert all(got[100 + k]["suffix_urls"] == pytest.approx(math.log1p(3)) for k in range(120))
