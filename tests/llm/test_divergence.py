import re
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import divergence as D
from quernstone.llm._common import ship
from tests.conftest import SF


def js(p, q):
    p, q = np.array(p, float), np.array(q, float)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_distances_match_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    chars = {r["doc_id"]: Counter(D._classes()[ord(c)] for c in r["text"]) for r in rows}
    words = {r["doc_id"]: Counter(re.findall(r"[^\W_]+", r["text"].lower())) for r in rows}
    total_c, total_w = {}, {}
    for r in rows:
        total_c.setdefault(r["lang"], Counter()).update(chars[r["doc_id"]])
        total_w.setdefault(r["lang"], Counter()).update(words[r["doc_id"]])
    common = {k: [w for w, n in c.items() if n >= D.COMMON_SHARE * c.total()] for k, c in total_w.items()}
    assert all(len(v) > 5 for v in common.values())
    bins = lambda c, lang: [*(c[w] for w in common[lang]), c.total() - sum(c[w] for w in common[lang])]
    for parts in (1, 7):
        got = {r["doc_id"]: r for r in D.judge(docs.repartition(parts)).collect()}
        assert len(got) == len(rows)
        for r in rows:
            g, k = got[r["doc_id"]], r["doc_id"]
            if len(r["text"]) < D.MIN_CHARS:
                assert g["chars_distance"] is None and g["keep"]
                continue
            classes = range(len(D.CLASSES))
            assert g["chars_distance"] == pytest.approx(js([chars[k][c] for c in classes], [total_c[r["lang"]][c] for c in classes]), abs=2e-6)
            n = words[k].total()
            if n >= D.MIN_WORDS:
                d = js(bins(words[k], r["lang"]), bins(total_w[r["lang"]], r["lang"]))
                assert g["words_distance"] == pytest.approx(d, abs=2e-6)
                assert g["keep"] == (g["chars_distance"] <= D.MAX_CHARS_DISTANCE and d <= D.MAX_WORDS_DISTANCE + D.WORDS_SLACK / np.sqrt(n))


def test_references_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "CASE WHEN doc_id % 9 > 0 THEN lang END AS lang", "text")
    want = sorted(map(str, D.judge(docs).collect()))
    monkeypatch.setattr(D, "MAX_BROADCAST", 0)
    found = D.judge(docs)
    assert sorted(map(str, found.collect())) == want


def test_any_language_has_common_words(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    text = lambda: " ".join(w for k in rng.integers(0, 500, 100) for w in ("bo", "ka", f"w{k}"))
    rows = [(k, "xx" if k < 50 else None, text()) for k in range(60)] + [(99, "xx", "qq ww ee rr tt yy " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    listed = D.candidates(docs)
    assert {"bo", "ka"} <= set(listed["xx"]) and {"bo", "ka"} <= set(listed[None])
    got = {r["doc_id"]: r for r in D.judge(docs).collect()}
    assert got[99]["words_distance"] > 1.2 * max(got[k]["words_distance"] for k in range(60)) and not got[99]["keep"]


def test_junk_goes_and_prose_stays(spark):
    ship(spark)
    prose = "The cat and the dog are in the house, and it is as warm as it was for us. "
    rows = [(k, "en", prose * (3 + k % 5)) for k in range(60)] + [(100, "en", "0x3F#@!%^&*()_+[]{}|<>~ 99871 " * 30), (101, "en", "zz qq " * 100), (102, "en", "##")]
    got = {r["doc_id"]: r["keep"] for r in D.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert all(got[k] for k in range(60)) and not got[100] and not got[101] and got[102]
