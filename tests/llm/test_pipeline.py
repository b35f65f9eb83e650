"""The pipeline's stages against the operators' own results, stage by stage."""

import hashlib

import corpus_pipeline as P
from pyspark.sql import functions as F

from lodestone.session import scratch


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, scratch(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["quality classifier"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lost = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.filter("quality = 1").count() <= 2 and lost.filter("quality = 0").count() >= 0.85 * before.join(labels, "doc_id").filter("quality = 0").count()
    before, after = seen["MinHash near-dedup"]
    rows = {r["doc_id"]: r["text"].lower().split() for r in before.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, w in rows.items()}
    kept = {r["doc_id"] for r in after.collect()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    order = sorted(kept)
    assert not any(near(a, b) for n, a in enumerate(order) for b in order[:n])
    assert all(any(near(a, b) for b in rows if b < a) for a in set(rows) - kept)
    before, after = seen["secret scans"]
    pairs = before.select("doc_id", F.col("text").alias("old")).join(after, "doc_id")
    changed = pairs.filter("old <> text")
    assert before.count() == after.count() and 0 < changed.count() < 0.3 * before.count()
    assert after.filter(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count() == 0
    assert changed.filter("n_chars <> length(text)").count() == 0
    before, after = seen["mixing sources to target weights"]
    most = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 3 and after.join(before, "doc_id", "left_anti").count() == 0
    out = P.STAGES[-1][1](spark, docs, sf)
    texts = sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect())
    assert sorted(r["decoded_sha256"] for r in out.collect()) == texts


def test_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
