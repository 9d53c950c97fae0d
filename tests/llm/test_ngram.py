import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quernstone.llm import ngram as N
from quernstone.llm._common import ship
from tests.conftest import SF


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 5), (1000, 3000), (1000, 10**9), (5000, 5000), (40_000, 100), (100, 40_000), (30_000, 90_000)])
def test_elias_fano_round_trip(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n))
    e = N.EliasFano.build(v, universe)
    assert (e.access(np.arange(n)) == v).all()
    if n:
        x = rng.integers(0, universe, 300)
        i, found = e.successor(x, np.zeros(300, np.int64), np.full(300, n))
        want = np.searchsorted(v, x, "left")
        assert (i == want).all() and all(f == (v[k] if k < n else -1) for f, k in zip(found, want))


def test_searches_read_few_places(tmp_path):
    """Memory-mapped files stay mapped: nothing as long as the level is held."""
    v = np.sort(np.random.default_rng(1).integers(0, 4_000_000, 1_000_000))
    N.EliasFano.build(v, 4_000_000).save(str(tmp_path / "x"))
    e = N.EliasFano.load(str(tmp_path / "x"))
    assert all(isinstance(getattr(e, f), np.memmap) for f in ("low", "high", "rank", "zeros"))
    assert e.rank.nbytes + e.zeros.nbytes < e.high.nbytes
    import tracemalloc

    tracemalloc.start()
    i, found = e.successor(v[::100_000], np.zeros(10, np.int64), np.full(10, len(v)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == v[::100_000]).all() and peak < 100_000


def test_scores_match_brute_force(spark, monkeypatch):
    """Whole rows from plain dictionaries. Without quantising they are equal; with it, a document's mean strays little."""
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text").cache()
    rows = docs.collect()
    plain = Plain([r["text"] for r in rows])
    coarse = {r["doc_id"]: r for r in N.score(docs.repartition(3)).collect()}
    monkeypatch.setattr(N, "quantise", lambda x: np.unique(x, return_inverse=True)[::-1] if len(x) else (np.zeros(0, int), np.zeros(1)))
    got = {r["doc_id"]: r for r in N.score(docs.repartition(3)).collect()}
    assert sorted(got) == sorted(coarse) == [r["doc_id"] for r in rows]
    for r in rows:
        s = (0,) * (N.ORDER - 1) + tuple(N.symbols([r["text"]])[0].tolist())
        want = sum(math.log(plain.p(s[k : k + N.ORDER])) for k in range(len(s) - N.ORDER + 1))
        g = got[r["doc_id"]]
        assert g["symbols"] == len(r["text"]) + 1 and g["log_probability"] == pytest.approx(want, abs=1e-3 * g["symbols"] + 1e-3)
        assert coarse[r["doc_id"]]["log_probability"] == pytest.approx(want, abs=0.05 * g["symbols"])
        assert g["bits_per_symbol"] == pytest.approx(-g["log_probability"] / math.log(2) / g["symbols"], abs=1e-4)


class Plain:
    """Interpolated Kneser-Ney over dictionaries, straight from its definition."""

    def __init__(self, texts):
        counts = [Counter() for _ in range(N.ORDER + 1)]
        for t in texts:
            s = (0,) * (N.ORDER - 1) + tuple(N.symbols([t])[0].tolist())
            counts[N.ORDER].update(s[k : k + N.ORDER] for k in range(len(s) - N.ORDER + 1))
        for k in range(N.ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts = counts
        self.discount, self.sums, self.kinds = [0.0], [None], [None]
        for k in range(1, N.ORDER + 1):
            ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
            self.discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
            sums, kinds = defaultdict(int), Counter(g[:-1] for g in counts[k])
            for g, c in counts[k].items():
                sums[g[:-1]] += c
            self.sums.append(sums)
            self.kinds.append(kinds)

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / N.SYMBOLS
        total = self.sums[k].get(g[:-1], 0)
        if not total:
            return self.p(g[1:])
        d = self.discount[k]
        return max(self.counts[k].get(g, 0) - d, 0) / total + d * self.kinds[k][g[:-1]] / total * self.p(g[1:])


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "ünï çödé", "the the the the"] * 2 + ["unseen zebra quartz"]


def test_trie_matches_definition(tmp_path):
    fit = TEXTS[:-1]
    keys, counts = np.unique(N.gram_keys(fit)[0], return_counts=True)
    N.write_model(keys, counts, str(tmp_path))
    trie, plain = N.Trie(str(tmp_path)), Plain(fit)
    for t in TEXTS:
        s = (0,) * (N.ORDER - 1) + tuple(N.symbols([t])[0].tolist())
        want = [math.log(plain.p(s[k : k + N.ORDER])) for k in range(len(s) - N.ORDER + 1)]
        got = trie.log_probability(N.gram_keys([t])[0])
        assert got == pytest.approx(want, abs=0.25)  # probabilities are quantised
        assert np.mean(np.abs(got - want)) < 0.05


def test_probabilities_sum_to_one(tmp_path):
    keys, counts = np.unique(N.gram_keys(TEXTS)[0], return_counts=True)
    N.write_model(keys, counts, str(tmp_path))
    trie = N.Trie(str(tmp_path))
    context = N.gram_keys(["the c"])[0][4] >> np.uint64(N.BITS)
    every = (context << np.uint64(N.BITS)) & N._MASK | np.arange(N.SYMBOLS, dtype=np.uint64)
    assert np.exp(trie.log_probability(every)).sum() == pytest.approx(1, abs=0.05)


def test_counts_cover_every_text(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.collect()]
    want = dict(zip(*(x.tolist() for x in np.unique(N.gram_keys(texts)[0], return_counts=True))))
    got = {}
    for r in N.counts(docs.repartition(5)).collect():
        for k, n in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist()):
            assert k not in got
            got[k] = n
    assert got == want


def test_prose_scores_better_than_noise(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) > 300")
    noise = spark.createDataFrame([(-1, "xq7 zk#9 vv%w jq!! 00zz " * 30)], "doc_id long, text string")
    path = N.fit(docs)
    got = {r["doc_id"]: r["bits_per_symbol"] for r in N.score(docs.unionByName(noise), path).collect()}
    assert got[-1] > 2 * np.median([v for k, v in got.items() if k >= 0])


HAN = ["".join(chr(0x4E00 + (7 * k + j) % 20_992) for j in range(9)) for k in range(400)] + ["the cat", "\x00\x01\x02", "ไทย", "the 𝒳 cat"]


def test_every_code_point_is_its_own_symbol():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) == 1]
    own = {c.lower() for c in every}
    s, _ = N.symbols(["".join(sorted(own))])
    assert len(set(s.tolist())) == len(own) + 1 and s[:-1].min() > 1


class PlainWide(Plain):
    def p(self, g):
        return super().p(g) if g else 1 / N.ALL


def test_wide_trie_matches_definition(tmp_path, monkeypatch):
    monkeypatch.setattr(N, "quantise", lambda x: np.unique(x, return_inverse=True)[::-1] if len(x) else (np.zeros(0, int), np.zeros(1)))
    fit = [*HAN[:-4:20], *HAN[-4:]]
    keys, counts = np.unique(N.gram_keys(fit)[0], return_counts=True)
    N.write_model(keys, counts, str(tmp_path))
    trie, plain = N.Trie(str(tmp_path)), PlainWide(fit)
    for t in [*fit, "日本語 never seen", chr(0x4E00) + chr(0x4E00 + 1024), "\U0010ffff"]:
        s = (0,) * (N.ORDER - 1) + tuple(N.symbols([t])[0].tolist())
        want = [math.log(plain.p(s[k : k + N.ORDER])) for k in range(len(s) - N.ORDER + 1)]
        assert trie.log_probability(N.gram_keys([t], True)[0]) == pytest.approx(want, abs=1e-4)


def test_counts_of_high_code_points_are_exact(spark):
    ship(spark)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(HAN)], "doc_id long, text string")
    want = dict(zip(*(x.tolist() for x in np.unique(N.gram_keys(HAN)[0], return_counts=True))))
    got = {}
    for r in N.counts(docs.repartition(5)).collect():
        keys = N._from(r["keys"], r["wide"])
        for k, n in zip((keys if r["wide"] else N.widened(keys)).tolist(), np.frombuffer(r["counts"], np.int64).tolist()):
            assert k not in got
            got[k] = n
    assert got == want
    path = N.fit(docs)
    strange = "".join(chr(0x4E00 + (4_999 * j + 3) % 20_992) for j in range(9))
    scored = N.score(docs.union(spark.createDataFrame([(-1, strange)], docs.schema)), N.fit(docs))
    got = {r["doc_id"]: r["bits_per_symbol"] for r in scored.collect()}
    assert got[-1] > 1.5 * got[0]


def test_symbols_beyond_a_narrow_model_are_unseen(tmp_path):
    keys, counts = np.unique(N.gram_keys(TEXTS)[0], return_counts=True)
    N.write_model(keys, counts, str(tmp_path))
    total, size = N.Scorer(str(tmp_path))(["the cat", "the 猫", "the 犬", "the qat"])
    assert size.tolist() == [8, 6, 6, 8] and total[1] == pytest.approx(total[2]) and total[1] / 6 < total[0] / 8
