from pyspark.sql import functions as F

from lodestone.functions import geometry, text


def one(spark, col, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(col.alias("x")).first()["x"]


def test_norm_ws_and_strip(spark):
    assert one(spark, text.norm_ws(F.col("t")), t=" 　a \n b\x1c ") == "a b"
    assert one(spark, text.norm_ws(F.col("t")), t=None) == ""


def test_like_folds_ascii_only_and_keeps_backslashes(spark):
    assert one(spark, text.like(F.col("t"), "AbC"), t="xxaBcxx")
    assert not one(spark, text.like(F.col("t"), "É"), t="é")
    assert one(spark, text.like(F.col("t"), "a_c"), t="abc")
    assert one(spark, text.like(F.col("t"), "a\\b"), t="xa\\bx")


def test_snippet(spark):
    t = "x" * 100 + "needle" + "y" * 100
    assert one(spark, text.snippet(F.col("t"), "NEEDLE"), t=t) == t[70:130]
    assert one(spark, text.snippet(F.col("t"), "zz"), t=t) == "x" * 60
    assert one(spark, text.snippet(F.col("t"), "z"), t="") == ""
    assert one(spark, text.snippet(F.col("t"), "b"), t="ab") == "ab"


def test_lines_follow_splitlines(spark):
    for t in ["", "a", "a\n", "a\r\nb\x0bc d\x85e", "\n", "a\n\n"]:
        assert one(spark, text.lines(F.col("t")), t=t) == t.splitlines()


def test_identifiers(spark):
    assert one(spark, text.doi(F.col("t")), t="see 10.1234/abc.d). x") == "10.1234/abc.d"
    assert one(spark, text.doi(F.col("t")), t="none") is None
    assert one(spark, text.arxiv_id(F.col("t")), t="https://arxiv.org/pdf/2401.12345v2") == "2401.12345"
    assert one(spark, text.doi_key(F.col("t")), t="DOI: 10.1/AB") == "10.1/ab"
    assert one(spark, text.arxiv_key(F.col("t")), t="https://arxiv.org/pdf/2401.12345v2.pdf") == "2401.12345"
    assert one(spark, text.title_key(F.col("t")), t="Ｆｕｌｌ—Straße: Ünï") == "full strasse ünï"


def test_replies(spark):
    assert one(spark, text.strip_json_fences(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.strip_json_fences(F.col("t")), t=" {} ") == "{}"
    assert one(spark, text.selection_of(F.col("t")), t="a ---SELECTION--- b --- c") == "b"
    assert one(spark, text.selection_of(F.col("t")), t="x" * 300) == "x" * 200
    assert one(spark, text.safe_filename(F.col("t")), t=" a/b:c. ") == "a_b_c"
    assert one(spark, text.safe_filename(F.col("t")), t="...") == "export"
    assert one(spark, text.render("{a} {b} {c}", {"a": F.col("t"), "b": F.lit("{a}")}), t="1") == "1 {a} {c}"
    assert one(spark, text.content_disposition(F.col("t")), t="é a.md") == "attachment; filename=\"_ a.md\"; filename*=UTF-8''%C3%A9%20a.md"
    assert one(spark, text.first_line(F.col("t")), t="\n  \n a \nb") == "a"
    assert one(spark, text.ellipsis(F.col("t"), 3), t="abcd") == "abc…"


def test_geometry(spark):
    good = '{"coordinate_system":"pymupdf_unrotated","units":"pt","rect":[1,1,5,5],"page_rect":[0,0,10,10],"rotation":0}'
    assert one(spark, geometry.parse(F.col("t")), t=good)["rect"] == [1, 1, 5, 5]
    for bad in (good.replace("[1,1,5,5]", "[5,1,1,5]"), good.replace("[0,0,10,10]", "[0,0,4,4]"), good.replace('"pt"', '"px"'), "{}", "x"):
        assert one(spark, geometry.parse(F.col("t")), t=bad) is None
    a, b = F.array(*map(F.lit, [0.0, 0.0, 2.0, 2.0])), F.array(*map(F.lit, [1.0, 0.0, 3.0, 2.0]))
    assert one(spark, geometry.overlap(a, b), t="") == 0.5
    assert one(spark, geometry.overlap(a, F.array(*map(F.lit, [1.0, 1.0, 1.0, 1.0]))), t="") is None
