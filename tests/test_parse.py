import random
import re

from lodestone.operators import blocks, context, parse, spans


def reference_blocks(content):
    """A plain reading of the rules, line by line."""
    out, para, code = [], [], None

    def end():
        if para:
            out.append(("para", None, " ".join(x.strip() for x in para)))
            para.clear()

    for line in content.splitlines():
        fence = line.startswith(("```", "~~~"))
        if code is not None:
            if fence:
                out.append(("code", None, "\n".join(code)))
                code = None
            else:
                code.append(line)
        elif fence:
            end()
            code = []
        elif re.match(r"#{1,6}\s+", line):
            end()
            level = len(line) - len(line.lstrip("#"))
            out.append(("heading", level, line[level:].strip()))
        elif line[:2] in ("- ", "* ", "+ ") or re.match(r"\d+\.\s", line):
            end()
            out.append(("list", None, line.lstrip("-*+ ").strip()))
        elif line.startswith(">"):
            end()
            out.append(("quote", None, line.lstrip("> ").strip()))
        elif not line.strip():
            end()
        else:
            para.append(line)
    end()
    if code:
        out.append(("code", None, "\n".join(code)))
    return out


def test_markdown_blocks_on_random_texts(spark):
    r = random.Random(1)
    lines = ["# A", "## B b", "####### no", "#x", "text", "  more ", "", "- item", "1. one", "12.x", "> q", ">", "```", "~~~ py", "* ", "　", "+ a", " - in", "# "]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 12))) + r.choice(["", "\n"])) for i in range(300)]
    docs += [(1000, None), (1001, "")]
    got = {}
    for row in parse.markdown_blocks(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "idx").collect():
        got.setdefault(row["doc_id"], []).append((row["kind"], row["level"], row["text"]))
    for i, t in docs:
        assert got.get(i, []) == reference_blocks(t or ""), t


def test_heading_paths_on_random_levels(spark):
    r = random.Random(2)
    rows, want = [], {}
    for d in range(60):
        stack = []
        for i in range(r.randint(1, 15)):
            heading, level = r.random() < 0.6, r.randint(1, 6)
            rows.append((d, i, "heading" if heading else "para", level if heading else None, f"t{i}"))
            if heading:
                stack = [s for s in stack if s[0] < level] + [(level, f"t{i}")]
            want[d, i] = " > ".join(t for _, t in stack)
    df = spark.createDataFrame(rows, "doc_id long, idx long, kind string, level int, text string")
    got = {(x["doc_id"], x["idx"]): x["heading_path"] for x in blocks.heading_paths(df).collect()}
    assert got == want


def test_block_ids_are_stable_and_count_repeats(spark):
    rows = [("v", 0, "para", "a"), ("v", 1, "para", "a"), ("v", 2, "para", "b"), ("w", 0, "para", "a")]
    ids = [x["id"] for x in blocks.block_ids(spark.createDataFrame(rows, "version_id string, idx long, kind string, text string")).orderBy("version_id", "idx").collect()]
    assert len(set(ids)) == 4
    moved = [("v", 5, "para", "b"), ("v", 6, "para", "a")]
    again = {x["text"]: x["id"] for x in blocks.block_ids(spark.createDataFrame(moved, "version_id string, idx long, kind string, text string")).collect()}
    assert again == {"a": ids[0], "b": ids[2]}


PAGE = """<html lang="en-GB"><head><title> T </title><meta name="citation_author" content="A"><meta name="citation_author" content="B">
<link rel="canonical" href="https://arxiv.org/abs/2401.12345"><meta property="article:published_time" content="May 2021"></head>
<body><nav><li>Menu</li></nav><div class="ad"><p>Buy now</p></div><h1>Head</h1><p>One <b>bold<p>Two
<script>var a = "<p>no</p>";</script> end<ul><li>item</li><li>item</li></ul><blockquote><p>Quoted</p></blockquote><pre>x = 1
y = 2</pre><table><tr><td>c1</td><td>c2</td></tr></table><p>.</p><footer><p>Foot</p></footer></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "http://x/a", PAGE), (2, "http://x/b", None), (3, "http://x/c", "")], "page_id long, url string, html string")
    got = [(r["kind"], r["level"], r["text"]) for r in parse.html_blocks(df).filter("page_id = 1").orderBy("idx").collect()]
    assert ("heading", 1, "Head") in got and ("list", None, "item") in got and ("quote", None, "Quoted") in [(k, lv, t) for k, lv, t in got] or ("para", None, "Quoted") in got
    texts = " ".join(t for _, _, t in got)
    assert "Menu" not in texts and "Buy" not in texts and "Foot" not in texts and "var a" not in texts
    assert sum(t == "item" for _, _, t in got) == 1
    m = {r["page_id"]: r for r in parse.html_metadata(df).collect()}
    assert m[1]["title"] == "T" and m[1]["authors"] == ["A", "B"] and m[1]["lang"] == "en" and m[1]["year"] == 2021 and m[1]["arxiv_id"] == "2401.12345"
    assert m[2]["title"] == "http://x/b"


def span(page, block, line, text, size, x0, y0, width=200.0):
    return ("s", page, 600.0, 800.0, block, line, 0, text, size, x0, y0, x0 + width, y0 + 10.0)


SPANS = "source_id string, page int, page_width double, page_height double, block_no int, line_no int, span_no int, text string, size double, x0 double, y0 double, x1 double, y1 double"


def test_span_blocks_two_columns(spark):
    rows = [span(1, 0, 0, "Title here", 18.0, 50.0, 40.0, 500.0)]
    for n in range(3):
        rows.append(span(1, 1 + n, 0, f"left {n}", 10.0, 50.0, 100.0 + 60 * n))
        rows.append(span(1, 11 + n, 0, f"right {n}", 10.0, 330.0, 90.0 + 60 * n))
    rows.append(span(1, 21, 0, "Table 1. Results", 10.0, 50.0, 300.0))
    rows.append(span(1, 22, 0, "first line", 10.0, 50.0, 400.0))
    rows.append(span(1, 22, 1, "second line", 10.0, 50.0, 412.0))
    regions = spark.createDataFrame([("s", 1, 50.0, 315.0, 250.0, 380.0, "drawing"), ("s", 1, 50.0, 381.0, 250.0, 384.0, "drawing")], "source_id string, page int, x0 double, y0 double, x1 double, y1 double, what string")
    got = spans.span_blocks(spark.createDataFrame(rows, SPANS), regions).orderBy("idx").collect()
    order = [r["text"] for r in got]
    assert order[0] == "Title here" and got[0]["kind"] == "heading" and got[0]["level"] == 1
    assert order.index("left 2") < order.index("right 0")
    assert "first line second line" in order
    assert [r["role"] for r in got if r["kind"] == "table"] == ["table_candidate"]
    assert [r["role"] for r in got if r["text"].startswith("Table 1")] == ["table_caption"]


def test_span_roles_and_bands(spark):
    rows = [span(1, 0, 0, "Figure 2a: A chart", 10.0, 50.0, 40.0), span(1, 1, 0, "E = mc^2", 10.0, 50.0, 60.0), span(1, 2, 0, "A heading,", 12.0, 50.0, 80.0), span(1, 3, 0, "Small heading", 12.0, 50.0, 100.0)]
    rows += [span(1, 4, 0, "first", 10.0, 50.0, 200.0), span(1, 4, 1, "far below", 10.0, 50.0, 240.0), span(1, 4, 2, "moved", 10.0, 70.0, 251.0), span(1, 4, 3, "  ", 10.0, 70.0, 262.0)]
    rows += [span(2, 0, 0, "ünï x", 10.0, 10.00049, 20.0), (None, 1, 600.0, 800.0, 0, 0, 0, "none", 10.0, 0.0, 0.0, 1.0, 1.0), ("s", 2, 600.0, 800.0, None, 0, 0, "none", 10.0, 0.0, 0.0, 1.0, 1.0)]
    images = [("s", 1, 60.0, 55.0, 200.0, 58.0, "image"), ("s", 1, 60.0, 61.0, 900.0, 90.0, "drawing"), ("s", 1, 300.0, 700.0, 305.0, 790.0, "image"), ("s", 3, 0.0, 0.0, 50.0, 50.0, "image")]
    regions = spark.createDataFrame(images, "source_id string, page int, x0 double, y0 double, x1 double, y1 double, what string")
    got = spans.span_blocks(spark.createDataFrame(rows, SPANS), regions).orderBy("idx").collect()
    by = {r["text"]: r for r in got if r["text"]}
    assert by["Figure 2a: A chart"]["role"] == "figure_caption" and by["E = mc^2"]["role"] == "equation_candidate"
    assert by["A heading,"]["kind"] == "para" and (by["Small heading"]["kind"], by["Small heading"]["level"]) == ("heading", 2)
    assert {"first", "far below", "moved"} <= set(by) and "none" not in by and by["ünï x"]["rect"][0] == 10.0
    assert [r["rect"] for r in got if r["kind"] == "figure"] == [[60.0, 55.0, 600.0, 90.0], [0.0, 0.0, 50.0, 50.0]]
    assert [r["page"] for r in got] == sorted(r["page"] for r in got) and [r["idx"] for r in got] == list(range(len(got)))
    m = spans.span_metadata(spans.span_blocks(spark.createDataFrame(rows, SPANS)), spark.createDataFrame([("s", " ", "A; B;")], "source_id string, title string, author string")).first()
    assert m["title"] == "Small heading" and m["authors"] == ["A", "B"]
    assert spans.span_blocks(spark.createDataFrame([], SPANS)).count() == 0


def test_repeated_and_null_page_keys(spark):
    df = spark.createDataFrame([(1, "http://x/a", PAGE)] * 3 + [(None, "http://x/b", "<p>Some text</p>")], "page_id long, url string, html string")
    assert parse.html_metadata(df).count() == 4
    assert parse.html_blocks(df).filter("page_id IS NULL").count() == 1


def test_packing_skips_and_goes_on(spark):
    r = random.Random(3)
    rows, want = [], {}
    for d in range(50):
        used, budget = 0, 100
        for p in range(1, r.randint(2, 12)):
            c = r.randint(1, 60)
            rows.append((d, p, c))
            want[d, p] = used + c <= budget
            used += c if want[d, p] else 0
    got = context.packed(spark.createDataFrame(rows, "doc_id long, place long, cost long"), 100)
    assert {(x["doc_id"], x["place"]): x["kept"] for x in got.collect()} == want


def test_excerpt_repeats_the_tail_only_in_long_documents(spark):
    df = spark.createDataFrame([(d, i, "para", None, "x" * 10) for d, n in ((1, 10), (2, 20)) for i in range(n)], "doc_id long, idx long, kind string, level int, text string")
    got = {r["doc_id"]: r["excerpt"] for r in blocks.excerpt(df, most=300).collect()}
    assert "中略" not in got[1] and got[1].count("xxxxxxxxxx") == 10
    assert "中略" in got[2]


def test_sections_number_by_first_appearance(spark):
    df = spark.createDataFrame([(1, 0, "", "a"), (1, 1, "X > Y", "b"), (1, 2, "", "Table 2b: c"), (1, 3, "Z", "d")], "doc_id long, idx long, heading_path string, text string")
    got = blocks.sections(df).orderBy("idx").collect()
    assert [r["section_id"] for r in got] == ["S0001", "S0002", "S0001", "S0003"]
    assert [r["parent_path"] for r in got] == ["", "X", "", ""]
    assert got[2]["candidate_label"] == "Table 2b" and got[1]["reference_id"] == "B000002"
    assert blocks.doc_text(df).first()["text"].startswith("a\nb\n")
