from pyspark.sql import functions as F

from lodestone.operators import register


def test_texts(spark):
    rows = [(1, "# T\n\nbody", "a.md", None), (2, " \n", None, None), (3, "plain", None, "Given"), (4, None, None, None), (5, "x", "n.MD", None)]
    df = spark.createDataFrame(rows, "doc_id long, content string, filename string, title string")
    r = register.texts(df, at=F.lit("now"))
    got = sorted((x["type"], x["title"]) for x in r.sources.collect())
    assert got == [("markdown", "T"), ("text", "Given"), ("text", "n.MD")]
    assert sorted(map(tuple, r.refused.collect())) == [("2", "empty"), ("4", "empty")]
    assert r.versions.count() == 3 and r.blocks.count() == 4
    assert r.blocks.filter("text = 'body'").first()["heading_path"] == "T"
    again = register.texts(df, known=r.sources, at=F.lit("now"))
    assert again.sources.count() == 0 and again.refused.filter("reason = 'duplicate'").count() == 3
    assert register.texts(df, known=r.sources, force=True, at=F.lit("now")).sources.count() == 3
    assert register.texts(df.limit(0)).sources.count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://x/a", "<title>T</title><p>Some text</p>"), (2, "ftp://x", "<p>no</p>"), (3, "http://x/b", None)], "page_id long, url string, html string")
    r = register.pages(df, at=F.lit("now"))
    assert {x["url"]: x["title"] for x in r.sources.collect()} == {"https://x/a": "T", "http://x/b": "http://x/b"}
    assert [x["key"] for x in r.refused.collect()] == ["2"] and r.blocks.count() == 1
    assert spark.sql("SELECT cast('%PDF-1.7' AS binary) AS c").select(register.is_pdf(F.col("c"))).first()[0]
