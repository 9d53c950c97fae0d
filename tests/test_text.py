import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import web as W
from quernstone.operators import clean as C
from quernstone.operators import dedup as D


@pytest.fixture(scope="module")
def of(spark):
    def run(f, *values):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
        return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]

    return run


def test_normalize(of):
    assert of(T.normalize, "hello   world", "a\n\n\n\nb", "hello&nbsp;world", " a\r\nb\t", None) == ["hello world", "a\n\nb", "hello world", "a\nb", None]


def test_boilerplate(of):
    got = of(T.strip_boilerplate, "Important article.\nCookie consent banner text.\nMore content.", "See http://x.y/z now. Mail a.b@c.de please.", "")
    assert got == ["Important article. More content.", "See  now. Mail  please.", ""]


def test_chunks(of):
    assert of(lambda t: T.chunks(t, 7), "aa\n\nbbb\n\ncc", "short") == [["aa\n\nbbb", "cc"], ["short"]]
    assert of(lambda t: T.chunks(t, 4), "abcdefghij", "") == [["abcdefghij"], [""]]


def test_entropy(of):
    assert of(T.char_entropy, "", "a", "aabb", None) == [0.0, 0.0, 1.0, None]
    assert of(T.char_entropy, "abcd")[0] == pytest.approx(2.0)


def test_syllables(of):
    assert of(T.syllables, "cat", "water", "beautiful", "make", "time", "a", "make.") == [1, 2, 3, 1, 1, 1, 2]


def test_language(of):
    pangram = "The quick brown fox and the dog went to the house with all of the people. " * 2
    assert of(T.detect_language, "", "日本語のテキスト", pangram, "lorem ipsum dolor sit amet", None) == ["unknown", "non-ascii", "en", "unknown", "unknown"]


def test_code_and_spam(of):
    code = "def f(x):\n    return x\nimport os\nx = call(1)\n"
    assert of(T.code_ratio, code)[0] > 0.5 and of(T.code_ratio, "Plain prose without any code here.")[0] < 0.1
    spam = lambda t: T.spam_score(t, T.words(t), T.sentences(t))
    low, high, none = of(spam, " ".join(f"word{k} goes somewhere else entirely" for k in range(30)), "BUY NOW!!! BUY NOW!!! CHEAP CHEAP!!!", "")
    assert high > low and none == 0.0 and high <= 1.0


def test_answers(of):
    assert of(T.normalize_answer, "42.", "Is it true?", "a   b\n\nc") == ["42", "is it true", "a b c"]
    assert of(T.strip_fence, "```json\n{}\n```", " plain ", "```open", "```\na\n```\nb\n```") == ["{}", "plain", "```open", "a\n```\nb"]
    assert of(T.first_number, "about 3/4 of 12", "none", "-1.5e") == ["3/4", "none", "-1.5"]


def test_tokens_and_names(of):
    assert of(T.estimate_tokens, "", "abc", "abcd", "a" * 9) == [1, 1, 1, 2]
    assert of(T.file_stem, "C++ & größe_1-2") == ["C_____größe_1-2"]


def test_nfkc_leaves_no_difference(spark):
    rows = [(k, t) for k, t in enumerate(["plain", "ﬁne", "é", "½", "ï", "日本", "a b", "\U0001d4b3", "İ", None, "–“”…"])]
    got = {r["k"]: r["text"] for r in T.nfkc(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert got == {k: t and unicodedata.normalize("NFKC", t) for k, t in rows}


def test_clean_chain_and_anchors(spark, read):
    docs = read("documents", "/root/testdata/sf0.01")
    counts = {r["drop_reason"]: r["docs"] for r in C.counters(C.decide(docs)).collect()}
    assert counts == {"kept": 405, "short": 32, "language": 563}
    prose = "The people and the house are in the town with all of their things, and they like it. " * 6
    rows = [(1, prose), (2, "x"), (3, "x = f(1);\n" * 40 + prose), (4, None)]
    got = C.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["word_count"] == 18 * 6 and got[0]["chunks"][0].startswith("The people")


def test_entropy_of_many_characters(spark):
    """Few and many different characters are counted in two ways, with one result."""
    import math
    from collections import Counter

    from quernstone.functions import text as T

    texts = ["", "aab", "a" * 1000, "".join(chr(0x4E00 + k * k % 3000) for k in range(20_000)), "".join(chr(32 + k % (T.KINDS + 1)) for k in range(5000)), "".join(chr(32 + k % T.KINDS) for k in range(5000)), "\U0001f600\U0001f680é", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["e"] for r in df.select("k", T.char_entropy(F.col("text")).alias("e")).collect()}
    for k, t in enumerate(texts):
        want = None if t is None else -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
        assert got[k] == want if want is None else abs(got[k] - want) < 1e-9


def _peak(run, texts):
    import tracemalloc

    tracemalloc.start()
    out = run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_python_rules_hold_few_texts_at_once():
    """Batches have 10,000 rows however long texts are: neither they nor results may all be strings at the same time."""
    texts = pa.array([None, "", *(f"<p>{k} {'word ' * 1000}</p>" for k in range(2000))])
    for udf, rule in ((W.html_text, W.html_to_text), (W.decoded, lambda t: t), (T._nfkc, lambda t: t), (D.simhash, D.fingerprint)):
        out, peak = _peak(udf.func, texts)
        assert out[:40].to_pylist() == [rule(t) if t is not None else None for t in texts[:40].to_pylist()] and len(out) == len(texts)
        assert peak < 5_000_000 < texts.nbytes
    assert len(W.html_text.func(texts[:0])) == 0


def test_measures_follow_the_column_rules(spark):
    """What Python counts is what words, sentences and syllables say, on odd white space, controls and case too."""
    texts = ["", " \n", "...", "Banane be eye. I! ae\x1cb\x85c\xa0d　e ÉTÉ İİ KelvinK ΟΔΟΣ ΑΣ.Α", "BUY NOW!!! BUY NOW!!! CHEAP", "a\x1eb\x1fc d?e e e e", "日本語 \U0001f600\U0001f680 make made. " * 9, "x" * 5000 + " one"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, t string")
    t = F.col("t")
    each = F.aggregate(T.words(t), F.lit(0), lambda s, w: s + T.syllables(w))
    got = df.select(T.measures(t).alias("m"), F.size(T.words(t)).alias("n_words"), F.size(T.sentences(t)).alias("n_sentences"), each.alias("n_syllables"), T.char_entropy(t).alias("entropy")).collect()
    for r in got:
        assert [r["m"][k] for k in ("n_words", "n_sentences", "n_syllables", "entropy")] == [r[k] for k in ("n_words", "n_sentences", "n_syllables", "entropy")]
    assert [round(r["m"]["spam"], 6) for r in got] == [0.0, 0.0, 0.3, 0.7, 1.0, 0.5, 0.3, 0.5, 0.0]  # as the lambdas of the JVM had them


def test_code_of_nothing_and_of_stripped_lines(of):
    """Lines are judged as stripped, and a null text has no code, as by the SQL."""
    assert of(T.code_ratio, None, "", "def  \n" + "a" * 94, " 　import x\nprose here", "a\nf(x) \n\n") == [0.0, 0.0, 0.04, 0.5, 0.25]
    assert of(T.strip, "\t\x85 a\x1c 　 ", " \n", "", None) == ["a\x1c", "", "", None]
