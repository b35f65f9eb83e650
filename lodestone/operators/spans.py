"""Positioned text (spans on pages) to ordered blocks, as column expressions over one row a page.

A line is one group of spans, a page one array of blocks: groups are bounded by a page, and all of it
stays inside Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arxiv_id, doi, norm_ws, strip

# Patterns of captions and equations in positioned text.
CAPTION = r"(?iU)^(Figure|Fig\.|Table)\s*\d+[a-z]?\s*[.:]"
EQUATION = r"(?U)^[\w\s+*/^().,−-]+\s*=\s*[^=]+(?:\(\d+\))?\z"

#: A block on a page: at is its place before ordering.
BLOCK = "struct<at:bigint,kind:string,role:string,level:int,text:string,x0:double,y0:double,x1:double,y1:double>"
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def let(body: str, /, **values: str) -> str:
    """SQL of body in which each name stands for its value, computed once; later values may use earlier names."""
    for name, value in reversed(values.items()):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body


def lines(spans: DataFrame) -> DataFrame:
    """One row a line that has text: its spans in order, collapsed, the largest size, the box of what isn't blank."""
    inked = strip(F.coalesce("text", F.lit(""))) != ""
    edge = lambda f, c: f(F.when(inked, F.bround(F.col(c).cast("double"), 3)))
    parts = F.array_sort(F.collect_list(F.struct("span_no", F.coalesce("text", F.lit("")).alias("t"))))
    rows = spans.filter("block_no IS NOT NULL AND line_no IS NOT NULL").groupBy("source_id", "page", "block_no", "line_no")
    rows = rows.agg(norm_ws(F.array_join(F.transform(parts, lambda p: p["t"]), "")).alias("text"), F.max("size").alias("size"), edge(F.min, "x0").alias("x0"), edge(F.min, "y0").alias("y0"), edge(F.max, "x1").alias("x1"), edge(F.max, "y1").alias("y1"))
    return rows.filter("text <> ''")


def line_roles(rows: DataFrame) -> DataFrame:
    """Lines with kind, role and level. body: the document's median span size."""
    caption = F.regexp_extract("text", CAPTION, 1)
    role = F.when(F.lower(caption) == "table", "table_caption").when(caption != "", "figure_caption")
    role = role.when((F.length("text") < 160) & F.col("text").rlike(EQUATION), "equation_candidate")
    heading = F.col("role").isNull() & (F.col("size") >= 1.15 * F.col("body")) & (F.length("text") < 120) & ~F.right("text", F.lit(1)).isin(".", ",", ";")
    d = rows.withColumn("role", role).withColumn("kind", F.when(heading, "heading").otherwise("para"))
    return d.withColumn("level", F.when(F.col("kind") == "heading", F.when(F.col("size") >= 1.5 * F.col("body"), 1).otherwise(2)))


def paragraphs(rows: DataFrame) -> DataFrame:
    """source_id, page and b, the blocks of each extraction block: lines that continue a paragraph join it.

    A line continues the one before if both are paragraphs of one role, its left edge is within 8 of
    the paragraph's and it begins less than a body size below the paragraph's lowest edge.
    """
    own = F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("bigint").alias("at"), "kind", "role", "level", "text", "x0", "y0", "x1", "y1")))
    d = rows.groupBy("source_id", "page", "block_no", "body").agg(own.alias("own"))
    goes_on = "size(a) > 0 AND b.kind = 'para' AND p.kind = 'para' AND b.role <=> p.role AND abs(p.x0 - b.x0) < 8 AND b.y0 - p.y1 >= 0 AND b.y0 - p.y1 < body"
    joined = "named_struct('at', p.at, 'kind', 'para', 'role', b.role, 'level', b.level, 'text', concat(p.text, ' ', b.text), 'x0', least(p.x0, b.x0), 'y0', least(p.y0, b.y0), 'x1', greatest(p.x1, b.x1), 'y1', greatest(p.y1, b.y1))"
    step = let(f"if({goes_on}, concat(slice(a, 1, size(a) - 1), array({joined})), concat(a, array(b)))", p="try_element_at(a, -1)")
    fold = f"aggregate(own, cast(array() as array<{BLOCK}>), (a, b) -> {step})"
    return d.select("source_id", "page", F.posexplode(F.expr(fold)).alias("nth", "b"), "block_no")


def page_regions(regions: DataFrame) -> DataFrame:
    """source_id, page, and r: boxes of images, with each drawing joined to what it touches within 3 points."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    boxes = lambda what: F.array_sort(F.collect_list(F.when(F.col("what") == what, box)))
    d = regions.groupBy("source_id", "page").agg(boxes("image").alias("images"), boxes("drawing").alias("drawings"), F.max("x1").alias("right"), F.max("y1").alias("bottom"))
    near = "o.x0 - 3 <= d.x1 AND o.x1 + 3 >= d.x0 AND o.y0 - 3 <= d.y1 AND o.y1 + 3 >= d.y0"
    side = lambda f, c: f"{f}(transform(m, o -> o.{c})) as {c}"
    whole = "struct(" + ", ".join([side("array_min", "x0"), side("array_min", "y0"), side("array_max", "x1"), side("array_max", "y1")]) + ")"
    step = let(f"concat(filter(a, o -> NOT ({near})), array({whole}))", m=f"concat(array(d), filter(a, o -> {near}))")
    grown = f"aggregate(drawings, cast(images as array<{_BOX}>), (a, d) -> {step})"
    return d.select("source_id", "page", F.expr(grown).alias("r"), "right", "bottom")


def candidates() -> Column:
    """Blocks for the regions r of a page with blocks b: clipped to the page, 8 points at least.

    A region is a table if exactly one caption is beside it, within 60 points above or below, and that
    is a table's; otherwise a figure.
    """
    clipped = "transform(r, o -> struct(greatest(o.x0, 0D) as x0, greatest(o.y0, 0D) as y0, least(o.x1, width) as x1, least(o.y1, height) as y1))"
    beside = "filter(b, c -> c.role IN ('figure_caption', 'table_caption') AND c.x0 < o.x1 AND c.x1 > o.x0 AND least(abs(c.y0 - o.y1), abs(c.y1 - o.y0)) < 60)"
    made = "named_struct('at', cast(size(b) + n as bigint), 'kind', if(tab, 'table', 'figure'), 'role', if(tab, 'table_candidate', 'figure_candidate'), 'level', cast(null as int), 'text', '', 'x0', o.x0, 'y0', o.y0, 'x1', o.x1, 'y1', o.y1)"
    made = let(made, near=beside, tab="size(near) = 1 AND element_at(near, 1).role = 'table_caption'")
    return F.expr(f"transform(filter({clipped}, o -> o.x1 - o.x0 >= 8 AND o.y1 - o.y0 >= 8), (o, n) -> {made})")


def with_places(pages: DataFrame) -> DataFrame:
    """Pages (b: all blocks, width) with placed: blocks and their sort key.

    The gutter is the gap between neighbouring edges of body blocks, at least 2.5 % of the width,
    with its middle in the central half and two body blocks on either side: the one with most blocks
    beside it, then the widest, then the rightmost. Blocks across it, and headings beside which there
    is nothing, divide the page into bands from top to bottom: a block belongs before the first of
    them that begins below its end. In a band the left column goes first.
    """
    values = {
        "t": "filter(b, x -> NOT coalesce(x.role IN ('figure_candidate', 'table_candidate'), false))",
        "body": "filter(t, x -> x.kind <> 'heading')",
        "edges": "array_sort(array_distinct(concat(transform(body, x -> x.x0), transform(body, x -> x.x1))))",
        "spaces": "zip_with(slice(edges, 1, greatest(size(edges) - 1, 0)), slice(edges, 2, greatest(size(edges) - 1, 0)), (e, f) -> struct(size(filter(body, x -> x.x1 <= e)) as l, size(filter(body, x -> x.x0 >= f)) as r, f - e as wide, (e + f) / 2 as middle))",
        "gaps": "filter(spaces, g -> g.wide >= 0.025 * width AND g.middle > 0.25 * width AND g.middle < 0.75 * width AND least(g.l, g.r) >= 2)",
        "cut": "array_max(transform(gaps, g -> struct(g.l + g.r as n, g.wide as wide, g.middle as middle))).middle",
        "crossing": "filter(b, x -> (x.x0 < cut AND cut < x.x1) OR (cut IS NOT NULL AND x.kind = 'heading' AND forall(t, o -> o.at = x.at OR o.y0 >= x.y1 OR o.y1 <= x.y0)))",
        "bars": "array_sort(transform(crossing, x -> struct(x.y0 as y0, x.x0 as x0, x.at as at)))",
        "order": "transform(bars, s -> s.at)",
    }
    own = "struct(int(nth) - 1 as band, 1 as bar, 0 as col, x.y0 as y, x.x0 as x, x.at as at)"
    first = "coalesce(array_min(transform(bars, (s, i) -> if(x.y1 <= s.y0, i, null))), size(bars))"
    other = f"struct({first} as band, 0 as bar, coalesce(int(x.x0 >= cut), 0) as col, x.y0 as y, x.x0 as x, x.at as at)"
    key = let(f"if(nth > 0, {own}, {other})", nth="array_position(order, x.at)")
    return pages.withColumn("placed", F.expr(let(f"transform(b, x -> struct({key} as key, x as b))", **values)))


def span_blocks(spans: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """source_id, idx, kind, level, text, page, role, rect of positioned text, page by page.

    spans: source_id, page, page_width, page_height, block_no, line_no, span_no, text, size, x0, y0, x1, y1.
    regions (images and drawings): source_id, page, what ('image' or 'drawing'), x0, y0, x1, y1. The
    body size is the document's median span size, 10 where it has none. Spans without a block or line
    number, and blank ones, make no block. Rows with a null source or page are left out.
    """
    spans = spans.filter("source_id IS NOT NULL AND page IS NOT NULL")
    body = spans.filter(F.trim("text") != "").groupBy(F.col("source_id").alias("_s")).agg(F.median("size").alias("body"))
    rows = lines(spans).join(body, F.col("source_id") == F.col("_s"), "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    found = paragraphs(line_roles(rows))
    at = F.array_sort(F.collect_list(F.struct("block_no", "nth", "b")))
    numbered = F.transform(at, lambda x, i: x["b"].withField("at", i.cast("bigint")))
    sizes = spans.groupBy("source_id", "page").agg(F.max("page_width").alias("width"), F.max("page_height").alias("height"))
    pages = sizes.join(found.groupBy("source_id", "page").agg(numbered.alias("b")), ["source_id", "page"], "left")
    if regions is not None:
        pages = pages.join(page_regions(regions.filter("source_id IS NOT NULL AND page IS NOT NULL")), ["source_id", "page"], "full")
        pages = pages.withColumn("width", F.coalesce("width", "right").cast("double")).withColumn("height", F.coalesce("height", "bottom").cast("double"))
    else:
        pages = pages.withColumn("r", F.expr(f"cast(null as array<{_BOX}>)"))
    pages = pages.withColumn("b", F.coalesce("b", F.expr(f"cast(array() as array<{BLOCK}>)"))).withColumn("r", F.coalesce("r", F.expr(f"cast(array() as array<{_BOX}>)")))
    pages = pages.withColumn("b", F.concat("b", candidates()))
    placed = with_places(pages).select("source_id", "page", F.explode("placed").alias("p"))
    idx = (F.row_number().over(Window.partitionBy("source_id").orderBy("page", "p.key")) - 1).cast("long")
    rect = F.array("p.b.x0", "p.b.y0", "p.b.x1", "p.b.y1")
    return placed.select("source_id", idx.alias("idx"), "p.b.kind", "p.b.level", "p.b.text", F.col("page").cast("int").alias("page"), "p.b.role", rect.alias("rect"))


def span_metadata(blocks: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """source_id, title, authors, doi, arxiv_id of positioned documents, from their blocks.

    info: source_id, title, author, as the file states them; a title there goes before that of the
    text, and authors are what semicolons separate.
    """
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") < 40, F.struct("idx", "text")))), lambda b: b["text"]), "\n")
    title = F.coalesce(F.min_by("text", F.when(F.col("kind") == "heading", F.col("idx"))), F.min_by(F.left("text", F.lit(120)), F.when(F.col("text") != "", F.col("idx"))), F.lit("Untitled PDF"))
    d = blocks.groupBy("source_id").agg(title.alias("title"), head.alias("head"))
    if info is None:
        d = d.withColumn("stated", F.lit(None).cast("string")).withColumn("author", F.lit(None).cast("string"))
    else:
        own = info.groupBy(F.col("source_id").alias("_i")).agg(F.min("title").alias("stated"), F.min("author").alias("author"))
        d = d.join(own, F.col("source_id") == F.col("_i"), "left")
    authors = F.filter(F.transform(F.split(F.coalesce("author", F.lit("")), ";"), strip), lambda a: a != "")
    return d.select("source_id", F.coalesce(F.nullif(strip("stated"), F.lit("")), "title").alias("title"), authors.alias("authors"), doi(F.col("head")).alias("doi"), arxiv_id(F.col("head")).alias("arxiv_id"))
