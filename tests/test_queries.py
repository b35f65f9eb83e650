"""Every query of the library against its SQL in DuckDB; those without SQL return rows."""

import pytest

from lodestone import queries as Q

WITH_SQL = sorted(Q.ORACLES)
WITHOUT = sorted(set(Q.QUERIES) - set(Q.ORACLES))


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(name, same):
    same(Q.QUERIES[name], Q.ORACLES[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(name, spark, sf):
    df = Q.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_lists_them_all():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
    assert set(Q.ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_span_blocks_hold_whole_texts(spark, sf, tmp_path):
    from collections import Counter

    long = " ".join(f"w{i}" for i in range(3000)) + " " + "y" * 200
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, long), (-2, "\n".join(f"line {i}" for i in range(400)))], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in Q.QUERIES["span_blocks"](spark, str(tmp_path)).orderBy("source_id", "idx").collect():
        got.setdefault(r["source_id"], []).append(r["text"])
    for r in docs.collect():
        assert Counter(" ".join(got.get(f"d{r['doc_id']}", [])).split()) == Counter(r["text"].split())
