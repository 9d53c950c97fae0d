import numpy as np
import pytest

from quernstone.llm import langid as L
from quernstone.llm._common import ship
from tests.conftest import SF

BIG = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def fitted(spark):
    """Fitted on even ids; odd ones are held out."""
    ship(spark)
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    held = docs.where("doc_id % 2 = 1").collect()
    return L.fit(docs.where("doc_id % 2 = 0")), held


def test_held_out_accuracy(fitted):
    model, held = fitted
    long = [r for r in held if len(r["text"]) >= 40]
    share, _, grams = L._infer_texts(model, [r["text"] for r in long])
    right = [model.names[int(k)] == r["lang"] for k, r in zip(share.argmax(1), long)]
    assert np.mean(right) >= 0.97
    assert L._kept(model, share, grams).mean() >= 0.99


def test_mixed_documents_have_both_languages(fitted):
    model, held = fitted
    by = {x: " ".join(r["text"] for r in held if r["lang"] == x) for x in ("en", "fr", "de")}
    for a, b in (("en", "fr"), ("de", "en")):
        share, _, _ = L._infer_texts(model, [by[a][:3000] + " " + by[b][:1000]])
        got = {model.names[k]: v for k, v in enumerate(share[0]) if v > 0}
        assert set(got) == {a, b} and got[a] == pytest.approx(0.75, abs=0.1)


def test_foreign_texts_are_rejected(fitted):
    model, _ = fitted
    share, _, grams = L._infer_texts(model, ["这是一个用来测试的中文文本" * 20, "Это русский текст для проверки языка " * 20, "zxqj kwvx qqzz xkcd jjqw " * 30])
    assert not L._kept(model, share, grams).any()


def test_expectation_maximisation_matches_direct_search(fitted):
    """With two components the proportion of highest likelihood is found by a fine grid as well."""
    model, held = fitted
    counts = L.trigram_counts([held[0]["text"][:400] + held[1]["text"][:400]])[0]
    p = model.p[:2]
    theta, ll = L._mixture(counts, p)
    grid = np.linspace(0, 1, 2001)[1:-1]
    values = [(counts * np.log(g * p[0] + (1 - g) * p[1])).sum() for g in grid]
    assert theta[0] == pytest.approx(grid[int(np.argmax(values))], abs=0.02) and max(values) - L.TOLERANCE <= ll <= max(values) + 1e-3


def climb(counts, p, rounds=800):
    """Expectation-maximisation straight from its definition: what each component takes of each trigram."""
    theta = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        taken = theta[:, None] * p / (theta[:, None] * p).sum(0)
        theta = (taken * counts).sum(1) / counts.sum()
    return theta, float((counts * np.log((theta[:, None] * p).sum(0))).sum())


def test_chosen_sets_match_brute_force(fitted):
    """All sets of all languages are tried by hand; the operator's search must not miss the best one."""
    from itertools import combinations

    model, held = fitted
    texts = [held[k]["text"][:300] + " " + held[k + 1]["text"][:600] for k in range(0, 14, 2)]
    counts = L.trigram_counts(texts)
    share, score = model.infer(counts)
    for c, s, mean in zip(counts, share, score):
        at = np.flatnonzero(c)
        best = (-np.inf, None, None, None)
        for size in range(1, len(model.names) + 1):
            for pick in combinations(range(len(model.names)), size):
                t, ll = climb(c[at], model.p[list(pick)][:, at]) if size > 1 else (np.ones(1), float(c[at] @ np.log(model.p[pick[0], at])))
                value = ll - L.PENALTY * np.log(c.sum()) / 2 * (size - 1)
                if t.min() >= L.MIN_SHARE and value > best[0] + 1e-6:
                    best = (value, pick, t, ll)
        assert tuple(np.flatnonzero(s)) == best[1]
        assert s[list(best[1])] == pytest.approx(best[2], abs=0.02) and mean * c.sum() == pytest.approx(best[3], abs=2 * L.TOLERANCE)


def languages(k, seed=0):
    """k languages that share some of their trigrams, and a writer of texts in them."""
    rng = np.random.default_rng(seed)
    words = [["".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 8))) for _ in range(40)] for _ in range(k)]
    text = lambda j, n, r: " ".join(r.choice(words[j], n))
    counts = np.array([L.trigram_counts([text(j, 4000, rng)])[0] for j in range(k)])
    return L.Model([f"l{j:02d}" for j in range(k)], counts), text


@pytest.mark.parametrize("k", [8, 12, 20, 60])
def test_text_of_many_languages_takes_no_long(k):
    """The search is polynomial: a text of 20 languages took minutes when all sets were tried."""
    import time

    model, text = languages(60)
    rng = np.random.default_rng(1)
    c = L.trigram_counts([" ".join(text(j, 400, rng) for j in range(k))])
    began = time.perf_counter()
    share, _ = model.infer(c)
    assert time.perf_counter() - began < 2
    used = np.flatnonzero(share[0])
    assert len(used) <= 1 / L.MIN_SHARE and (share[0][used] >= L.MIN_SHARE).all() and share.sum() == pytest.approx(1)
    assert k > 8 or set(used) == set(range(k))


def test_sets_match_brute_force_with_more_languages():
    from itertools import combinations

    model, text = languages(7, 2)
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 4):
        c = L.trigram_counts([" ".join(text(int(j), 300, rng) for j in rng.choice(7, k, replace=False))])[0]
        at = np.flatnonzero(c)
        found = []
        for size in range(1, 6):
            for pick in combinations(range(8), size):
                t, ll = climb(c[at], model.p[list(pick)][:, at], 300)
                if t.min() >= L.MIN_SHARE:
                    found.append((ll - L.PENALTY * np.log(c.sum()) / 2 * (size - 1), pick))
        assert tuple(np.flatnonzero(model.infer(c[None])[0][0])) == max(found)[1]


def test_results_do_not_depend_on_batches(fitted):
    model, held = fitted
    texts = [r["text"] for r in held[:300]]
    share, score, _ = L._infer_texts(model, texts)
    for k in range(0, 300, 7):
        s, v, _ = L._infer_texts(model, [texts[k]])
        assert v[0] == pytest.approx(score[k], abs=1e-12) and s[0] == pytest.approx(share[k], abs=1e-9)


def test_emoji_are_no_letters():
    assert not L.trigram_counts(["\U0001f600 \U0001f680 123 !?"]).any() and L.trigram_counts(["\U0001d4b3\u65e5"]).sum() == 2


def test_stage_keeps_clean_documents(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert L.keep_identified(docs).count() >= 0.99 * docs.count()


def test_every_tag_is_told_apart(spark):
    """150 tags, each with words of its own; the rarest count as well."""
    ship(spark)
    words = lambda k: [chr(97 + k % 13) + chr(97 + k // 13) + chr(97 + (k + 5 * j) % 26) + "aeiou"[j % 5] for j in range(12)]
    text = lambda k: " ".join(words(k)[(j * 7 + j * j) % 12] for j in range(120))
    rows = [(k, text(k // 2 if k < 300 else 0), f"t{k // 2 if k < 300 else 0:03d}") for k in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.names == [*(f"t{k:03d}" for k in range(150)), L.UNKNOWN]
    found = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert all(found[k]["language"] == lang and found[k]["keep"] for k, _, lang in rows)
