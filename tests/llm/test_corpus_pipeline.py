"""The whole pipeline against a brute-force version, row by row and pair by pair in Python."""

import hashlib
from collections import Counter

import corpus_pipeline
from quernstone.llm import langid, mixing, packing, toxicity
from quernstone.llm._common import ship
from tests.conftest import SF
from tests.llm.test_mixing import fill
from tests.llm.test_simhash import brute


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_matches_brute_force(spark):
    ship(spark)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table.orderBy("doc_id").collect()
    model = langid.fit(table)
    share, _, grams = langid._infer_texts(model, [r["text"] for r in docs])
    docs = [r for r, keep in zip(docs, langid._kept(model, share, grams)) if keep]
    ids = [r["doc_id"] for r in docs]
    model = toxicity.fit(table.where(table["doc_id"].isin(ids)), spark.read.parquet(f"{SF}/labels.parquet"))
    severity = model.severity([r["text"] for r in docs])[0]
    docs = [r for r, s in zip(docs, severity) if s < toxicity.TOXIC]
    gone, _ = brute([r["text"] for r in docs], [r["doc_id"] for r in docs])
    docs = [r for r in docs if r["doc_id"] not in gone]
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += len(r["text"])
    taken = fill(sizes, dict.fromkeys(sizes, 1.0), mixing.MAX_EPOCHS, sum(sizes.values()))
    want = Counter()
    for r in docs:
        epochs = taken[r["source"]] / sizes[r["source"]]
        hashed = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        want[r["doc_id"]] = int(epochs) + (hashed < epochs - int(epochs))
    length = {r["doc_id"]: len(r["text"]) for r in docs}
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["tokens"] == sum(p["tokens"] for p in r["pieces"]) <= packing.CAPACITY
        for p in r["pieces"]:
            got[p["doc_id"]] += p["chars"]
    assert got == Counter({k: n * length[k] for k, n in want.items() if n * length[k]})
