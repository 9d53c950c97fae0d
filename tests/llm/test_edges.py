"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import audio, divergence, langid, licenses, mixing, ngram, packing, simhash, toxicity, urls
from quernstone.llm._common import ship
from tests.llm.conftest import LONG, ROWS

OPERATORS = {
    "mixing": lambda d, labels: mixing.repetitions(d), "toxicity": toxicity.score, "audio": lambda d, labels: audio.features(d, F.col("text")),
    "simhash": lambda d, labels: simhash.near_duplicates(d), "divergence": lambda d, labels: divergence.judge(d), "packing": lambda d, labels: packing.pack(d),
    "licenses": lambda d, labels: licenses.scan(d), "ngram": lambda d, labels: ngram.score(d), "langid": lambda d, labels: langid.identify(d),
}


def rows(df):
    drop = [c for c in df.columns if c in ("features", "segments")]
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, nasty, clashing, labels, name):
    ship(spark)
    assert rows(OPERATORS[name](clashing, labels)) == rows(OPERATORS[name](nasty, labels))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, labels, name):
    ship(spark)
    assert OPERATORS[name](empty, labels).collect() == []


@pytest.mark.parametrize("name", ["mixing", "toxicity", "divergence", "ngram", "langid"])
def test_a_row_for_every_row_with_its_id(spark, nasty, labels, name):
    ship(spark)
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in OPERATORS[name](nasty, labels).collect()), key=key) == sorted((r[0] for r in ROWS), key=key)


def test_stages_on_tasks_without_rows(spark, nasty, labels, tmp_path):
    ship(spark)
    few = nasty.where("doc_id = 6").repartition(12)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, few, str(tmp_path))) == rows(stage(spark, few.coalesce(1), str(tmp_path)))


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_depend_on_partitions(spark, nasty, labels, name):
    """Whole rows, but for features of audio, which other tests hold against definitions; some of the tasks have no rows."""
    ship(spark)
    assert len(ROWS) < 16
    assert rows(OPERATORS[name](nasty.repartition(16), labels)) == rows(OPERATORS[name](nasty.coalesce(1), labels))


@pytest.fixture
def sf_dir(spark, tmp_path, nasty, labels):
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_documents(spark, nasty, clashing, empty, sf_dir, name, stage):
    ids = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    kept = ids(stage(spark, nasty, sf_dir))
    for docs in (nasty, clashing, empty):
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        assert {str(r) for r in found.collect()} <= {str(r) for r in docs.collect()}
        assert ids(found) == (kept if docs is not empty else [])
    # Clean documents stay, whatever stands beside them.
    if name in ("toxicity", "near_dedup"):
        assert {2, 3, 4, 5, 6, 8, 9_007_199_254_740_993} <= {i for i, _ in kept}
    elif name == "language_id":
        assert {6, 9_007_199_254_740_993} <= {i for i, _ in kept}


def test_last_stage_packs_every_text(spark, nasty, clashing, empty, sf_dir):
    stage = dict(corpus_pipeline.STAGES)["packing"]
    assert rows(stage(spark, clashing, sf_dir)) == rows(stage(spark, nasty, sf_dir))
    assert sum(p["chars"] for r in stage(spark, nasty, sf_dir).collect() for p in r["pieces"]) == sum(len(r[1]) for r in ROWS if r[1])
    assert stage(spark, empty, sf_dir).collect() == []


def test_pipeline_with_clashing_columns(spark, clashing, labels, tmp_path, sf_dir):
    other = str(tmp_path / "clashing")
    clashing.write.parquet(f"{other}/documents.parquet")
    labels.write.parquet(f"{other}/labels.parquet")
    assert rows(corpus_pipeline.run(spark, other)) == rows(corpus_pipeline.run(spark, sf_dir))


def test_pipeline_on_edge_cases(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["shard", "bin", "pieces", "tokens", "waste"]
    assert {p["doc_id"] for r in found.collect() for p in r["pieces"]} <= {r[0] for r in ROWS}


def test_pipeline_on_an_empty_table(spark, tmp_path, empty, labels):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_defined_results(spark, nasty, labels):
    ship(spark)
    by = lambda df, k="doc_id": {r[k]: r for r in df.collect() if r[k] is not None}
    tox = by(toxicity.score(nasty, labels))
    assert tox[2]["toxic"] is False and tox[1]["severity"] == tox[2]["severity"]
    lang = by(langid.identify(nasty))
    assert lang[1]["language"] is None and not lang[4]["keep"] and lang[1]["languages"] == []
    score = by(ngram.score(nasty))
    assert score[1]["symbols"] == 1 == score[2]["symbols"] and score[9_007_199_254_740_993]["symbols"] == len(LONG) + 1
    dist = by(divergence.judge(nasty))
    assert dist[1]["keep"] and dist[1]["chars_distance"] is None
    mixed = by(mixing.repetitions(nasty))
    assert mixed[2]["epochs"] == mixed[7]["epochs"] and mixed[4]["repetitions"] >= 0
    packed = packing.pack(nasty).collect()
    assert sum(p["chars"] for r in packed for p in r["pieces"]) == sum(len(r[1]) for r in ROWS if r[1])
    gone = simhash.near_duplicates(nasty).collect()
    assert {(r["doc_id"], r["duplicate_of"], r["copies"]) for r in gone} == {(6, 6, 1), (7, 6, 1)}


def test_urls(spark):
    ship(spark)
    found = [("http://ads.example.com/a?x=1", 1), ("http://ads.example.com/a?x=1", 1), (None, 2), ("", 3), ("no host", 4), ("https://" + "x" * 5000 + ".org/p", 9_007_199_254_740_993), ("http://good.example.com/", None)]
    pages = spark.createDataFrame([(i, u, None, "own") for u, i in found], "page_id long, url string, html string, suffix string")
    got = urls.score(pages).collect()
    assert len(got) == len(found) and 9_007_199_254_740_993 in {r["page_id"] for r in got}
    assert all(r["keep"] and r["probability"] is None for r in got if r["page_id"] in (2, 3, 4))
    assert len({r["probability"] for r in got if r["page_id"] == 1}) == 1
    assert urls.score(pages.limit(0)).collect() == []
    none = spark.createDataFrame([], "url string, bad int")
    assert {r["probability"] for r in urls.score(pages, none).collect()} == {None, 0.5}


def test_urls_ignore_other_columns(spark):
    from tests.llm.conftest import CLASHING

    ship(spark)
    found = [(k, f"http://h{k % 3}{'.ads' if k % 4 == 0 else ''}.example.com/{'x' * (k % 50)}?q={k}") for k in range(80)] + [(None, None), (7, "http://h1.example.com/long/" + "y" * 100_000), (8, ""), (8, "")]
    pages = spark.createDataFrame(found, "page_id long, url string")
    more = pages.select("*", *[F.lit(f"own {c}").alias(c) for c in [*CLASHING, *urls.SUFFIX, "urls", "hosts", "bad", "probability"] if c != "url"])
    want = rows(urls.score(pages))
    assert rows(urls.score(more)) == want and len(want) == len(found)
    assert rows(urls.score(pages.repartition(9))) == want
