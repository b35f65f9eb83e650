"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "cls", "word", "score", "_size", "_key", "h", "n", "kept", "label", "of", "bk", "_id", "_label", "held_out", "rest"]


def rows():
    words = " ".join(f"word{i} tale" for i in range(60))
    out = [(1, "one two three four five", "en", "a", 5), (1, "one two three four five", "en", "a", 5), (2, None, None, None, None), (None, "one two three four five", "en", None, 1)]
    out += [(3, "", "de", "b", 0), (4, " \n\t ", "de", "b", 0), (5, words + ".", "fr", "a", None), (6, words + " end", "fr", "b", 7), (7, "ünï " * 3, None, "c", 1)]
    out += [(8, ("lorem ipsum dolor sit amet consectetur " * 4000), "en", "a", 1), (9, "x" * 50_000, "en", "a", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (8, 0, 0), (9, None, None), (None, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def all_ids():
    return sorted((r[0] is None, r[0] or 0) for r in rows())


def test_quality_rules(docs, empty):
    from lodestone.llm.quality_rules import filtered, judge

    df = judge(docs)
    assert ids(df) == all_ids()
    assert all(r["base_failed"] and not r["kept"] for r in df.filter("doc_id IN (1, 2, 3, 4, 9)").collect())
    assert df.filter("doc_id = 5").first()["kept"]
    assert df.filter("doc_id = 8").first()["base_failed"]
    out = filtered(docs)
    assert out.columns == docs.columns and ids(out) == ids(df.filter("kept"))
    assert judge(empty).count() == 0 and filtered(empty).count() == 0


def test_lattice(docs, empty):
    import public_tokenizers
    from lodestone.llm.lattice import score

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = score(docs, path)
    assert ids(got) == all_ids()
    assert all(r["n_tokens"] == 1 for r in got.filter("doc_id IN (2, 3, 4)").collect())
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got.collect())
    assert score(empty, path).count() == 0


def test_secrets(docs, empty):
    from lodestone.llm.secrets import redacted, scan

    got = scan(docs)
    assert ids(got) == all_ids()
    assert got.filter("spans <> ''").count() == 0
    back = redacted(docs)
    assert back.columns == docs.columns and back.exceptAll(docs).count() == 0
    assert scan(empty).count() == 0 and redacted(empty).count() == 0


def test_quality_net(docs, empty, labels):
    from lodestone.llm.quality_net import accepted, fit, score

    net = fit(docs, labels)
    got = score(docs, net)
    assert ids(got) == all_ids() and got.filter("score BETWEEN 0 AND 1").count() == len(rows())
    assert accepted(docs, net, 0.0).columns == docs.columns and accepted(docs, net, 0.0).count() == len(rows())
    assert accepted(docs, net, 1.1).count() == 0
    none = fit(empty, labels)
    assert score(empty, none).count() == 0 and score(docs, none).first()["score"] == 0.5


def test_toxicity(docs, empty, labels):
    from lodestone.llm.toxicity import fit, score

    model, limits = fit(docs, labels)
    got = score(docs, model, limits)
    assert ids(got) == all_ids() and got.filter("score BETWEEN 0 AND 1").count() == len(rows())
    none, limits = fit(empty, labels)
    assert score(empty, none, limits).count() == 0 and score(docs, none, limits).count() == len(rows())


def test_mixing(docs, empty):
    from lodestone.llm.mixing import mix, mixed

    got = mix(docs)
    assert ids(got) == all_ids()
    assert all(r["taken"] <= 3 * r["size"] for r in got.collect())
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == got.agg(F.sum("copies")).first()[0]
    assert mix(empty).count() == 0 and mixed(empty).count() == 0


def test_near_duplicates(docs, empty):
    from lodestone.llm.neardup import deduplicated, near_duplicates

    got = near_duplicates(docs)
    assert ids(got) == all_ids()
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by[1]["component_id"] == 1 and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i for i in (2, 3, 4))
    null = got.filter("doc_id IS NULL AND n_shingles > 0").first()
    assert null["component_id"] == 1 and not null["kept"]
    out = deduplicated(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 6").count() == 0 and out.filter("doc_id = 5").count() == 1
    assert out.filter("doc_id = 1").count() == 1 and out.filter("doc_id IS NULL AND text IS NOT NULL").count() == 0
    assert out.filter("doc_id IS NULL AND text IS NULL").count() == 1 and out.filter("doc_id IN (2, 3, 4)").count() == 3
    assert near_duplicates(empty).count() == 0 and deduplicated(empty).count() == 0


def test_repeated_rows_and_null_ids_are_deduplicated(spark):
    from lodestone.llm.neardup import deduplicated, full_sets, grouped

    base = " ".join(f"w{i}" for i in range(100))
    near, other = base + " tail", " ".join(f"v{i}" for i in range(100))
    own = [(5, base, "en")] * 400 + [(7, near, "en")] * 300 + [(None, other, "de")] * 5 + [(None, other + " tail", None)] * 3
    own += [(9, near, "en"), (9, "an unrelated text of several words", "en"), (9, "an unrelated text of several words", "fr"), (11, "alone in its group", "en"), (12, "", "en"), (12, None, "en")]
    df = spark.createDataFrame(own, "doc_id long, text string, lang string").withColumn("cls", F.lit("clash")).withColumn("_rest", F.lit(1)).repartition(6)
    left = deduplicated(df)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert left.columns == df.columns
    assert got[:4] == [(False, 5, base), (False, 9, "an unrelated text of several words"), (False, 11, "alone in its group"), (False, 12, "")]
    assert len(got) == 5 and got[4][:2] == (True, 0) and got[4][2].startswith(other)
    _, classes = grouped(df, 5, 80)
    wanted = classes.select("cls", "doc_id")
    sets = full_sets(df, 5, wanted)
    assert sets.count() == wanted.count() == sets.select("cls").distinct().count()


def test_bpe(docs, empty):
    import public_tokenizers
    from lodestone.llm.bpe import decode, encode

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = encode(docs, path, pattern)
    assert ids(got) == all_ids()
    want = {r[0]: (r[1] or "").encode() for r in rows() if r[0] is not None}
    for r in decode(got.filter("doc_id IS NOT NULL"), path, pattern).collect():
        assert bytes(r["data"]) == want[r["doc_id"]]
    assert encode(empty, path, pattern).count() == 0
    lists = got.filter("doc_id = 1").limit(1).withColumn("ids", F.expr("cast(null as array<int>)"))
    assert bytes(decode(lists, path, pattern).first()["data"]) == b""


def test_neighbours(spark):
    from lodestone.llm.neighbours import search

    same = [0.5, 0.5, 0.0]
    vs = [(i, same) for i in range(30)] + [(40, [1.0, 0.0, 0.0]), (41, [0.0, 0.0, 0.0]), (42, None), (43, [float("nan"), 1.0, 1.0]), (44, [float("inf"), 1.0, 1.0]), (45, [1.0, None, 1.0]), (46, [1.0]), (None, same), (3, same)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    first = [r["vec_id"] for r in got if r["query_id"] == 0]
    every = sorted([*range(1, 30), 3])  # the row that is there twice is found twice
    assert first == every[:20]  # 40 is as near; ties go to the smaller id
    assert [r["vec_id"] for r in got if r["query_id"] == 40] == [0, *every[:19]]
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = search(df.filter("vec_id = 40"), F.col("vec_id") % 20 == 0)
    assert one.count() == 0


def test_components(spark):
    from lodestone.llm.components import components

    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (None, 3), (7, None)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and len(got) == 42
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """Rows that share an id are all found, and all of them ask; against brute force."""
    import random

    from lodestone.llm.neighbours import search

    got = search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.1, 0.0]), (1, [9.0, 0.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 9.0), (2, 1, 0.1)]
    r = random.Random(4)
    rows = [(r.randrange(40), [float(r.randint(-3, 3)) for _ in range(3)]) for _ in range(150)]
    rows += [(0, [1.0, 2.0, 3.0])] * 30 + [(7, [1.0, 2.0, 3.0])] * 5
    rows = [x for x in rows if any(x[1])]
    want = []
    for q, x in rows:
        if q % 10 == 0:
            near = sorted(((-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q))[:20]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(tuple(x) for x in search(df, F.col("vec_id") % 10 == 0).collect()) == sorted(want)
