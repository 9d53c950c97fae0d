"""Queries of duplicate removal."""

from __future__ import annotations

from quernstone.operators import dedup as D
from quernstone.plans.registry import query, table

_SUMS = ", ".join(f"sum(CASE WHEN (h >> {k}) & 1::UBIGINT = 1 THEN c ELSE -c END) AS b{k}" for k in range(64))
_VALUE = " + ".join(f"(CASE WHEN b{k} > 0 THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(64))
FP = rf"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM documents),
hashed AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h, count(*) AS c FROM tok GROUP BY ALL),
sums AS (SELECT doc_id, {_SUMS} FROM hashed GROUP BY doc_id),
fps AS MATERIALIZED (SELECT d.doc_id, coalesce({_VALUE}, 0::UBIGINT) AS fp, md5(text) AS digest FROM documents d LEFT JOIN sums USING (doc_id))"""
WALK = f"""WITH RECURSIVE {FP},
seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS rn, * FROM fps),
walk AS (
  SELECT 0::BIGINT AS rn, -1::BIGINT AS doc_id, NULL::VARCHAR AS strategy, NULL::BIGINT AS duplicate_of, NULL::DOUBLE AS similarity, []::UBIGINT[] AS kf, []::VARCHAR[] AS kd, []::BIGINT[] AS ki
  UNION ALL
  SELECT rn, doc_id, CASE WHEN e > 0 THEN 'exact' WHEN n > 0 THEN 'simhash' END, CASE WHEN e > 0 THEN ki[e] WHEN n > 0 THEN ki[n] END,
    CASE WHEN e > 0 THEN 1.0::DOUBLE WHEN n > 0 THEN 1 - bit_count(xor(kf[n], fp))::DOUBLE / 64 END,
    CASE WHEN e > 0 OR n > 0 THEN kf ELSE list_append(kf, fp) END, CASE WHEN e > 0 OR n > 0 THEN kd ELSE list_append(kd, digest) END, CASE WHEN e > 0 OR n > 0 THEN ki ELSE list_append(ki, doc_id) END
  FROM (SELECT s.rn, s.doc_id, s.fp, s.digest, w.kf, w.kd, w.ki, coalesce(list_position(w.kd, s.digest), 0) AS e,
      coalesce(list_position(list_transform(w.kf, lambda f: bit_count(xor(f, s.fp)) <= {D.DISTANCE}), true), 0) AS n
    FROM walk w JOIN seq s ON s.rn = w.rn + 1)),
decided AS (SELECT doc_id, strategy IS NOT NULL AS is_duplicate, strategy, duplicate_of, similarity FROM walk WHERE rn > 0)"""


@query("SELECT doc_id, first AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) WHERE doc_id > first")
def doc_md5_exact_dups(spark, sf_dir):
    return D.exact_duplicates(table(spark, sf_dir, "documents"))


@query(f"WITH {FP} SELECT doc_id, fp::VARCHAR AS fingerprint FROM fps")
def doc_simhash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.unsigned(D.simhash("text")).alias("fingerprint"))


CLASSES = "cls AS MATERIALIZED (SELECT fp, min(doc_id) AS class_id, count(*) AS copies FROM fps GROUP BY fp)"
_NEAR = f"bit_count(xor(x.fp, y.fp)) <= {D.DISTANCE}"


@query(f"""WITH {FP}, {CLASSES} SELECT x.class_id AS a, y.class_id AS b, bit_count(xor(x.fp, y.fp))::INTEGER AS distance, x.copies AS copies_a, y.copies AS copies_b
FROM cls x JOIN cls y ON x.class_id < y.class_id AND {_NEAR}""")
def near_dup_pairs(spark, sf_dir):
    """Pairs of classes of equal fingerprints; ``near_dup_classes`` has the class of each document."""
    return D.near_pairs(table(spark, sf_dir, "documents"))


@query(f"""WITH {FP}, {CLASSES}, links AS (SELECT x.class_id, count(*) AS links FROM cls x JOIN cls y ON x.fp <> y.fp AND {_NEAR} GROUP BY 1)
SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM fps JOIN cls USING (fp) LEFT JOIN links USING (class_id)""")
def near_dup_classes(spark, sf_dir):
    return D.near_classes(table(spark, sf_dir, "documents"))


@query("SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM benchmark)")
def exact_membership(spark, sf_dir):
    return D.is_registered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id")


@query(f"WITH {FP}, {CLASSES} SELECT x.doc_id AS probe, y.class_id, y.copies, bit_count(xor(x.fp, y.fp))::INTEGER AS distance FROM fps x JOIN labels l USING (doc_id) JOIN cls y ON {_NEAR} WHERE l.toxic = 1")
def near_matches_of_toxic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    probes = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return D.near_matches(probes, docs)


@query(WALK + " SELECT * FROM decided")
def dedup_greedy(spark, sf_dir):
    return D.greedy(table(spark, sf_dir, "documents"))


@query(WALK + """ SELECT count(*) AS total, count(*) FILTER (WHERE strategy = 'exact') AS exact_duplicates,
count(*) FILTER (WHERE strategy = 'simhash') AS near_duplicates, count(*) FILTER (WHERE NOT is_duplicate) AS "unique" FROM decided""")
def dedup_report(spark, sf_dir):
    return D.report(D.greedy(table(spark, sf_dir, "documents")))


@query(WALK + " SELECT doc_id, duplicate_of, similarity FROM decided WHERE is_duplicate")
def dedup_pairs(spark, sf_dir):
    return D.pairs(D.greedy(table(spark, sf_dir, "documents")))
