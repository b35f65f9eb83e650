"""The map of a document: its headings as a tree in nested-set numbers, with what each subtree holds.

A heading's subtree ends at the next heading of its level or a higher one. All counts of subtrees are
differences of running totals, so that nothing is joined by interval: one sort of the blocks, and one of
the headings the other way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LEVELS, caption_label


def outline(blocks: DataFrame, marks: DataFrame | None = None, key: str = "doc_id", names: tuple[str, ...] = ("notes", "anchors")) -> DataFrame:
    """key, idx, level, title, depth, parent_idx, lft, rgt, end_idx, blocks, characters and the sums of ``names``: one row a heading.

    marks: key, idx and a number for each of ``names`` (one row a block at most; none counts as 0). blocks,
    characters and the sums are those of the subtree, the heading included. end_idx is the idx of the block that
    follows the subtree, or one more than the last block's. A missing level is 1, one above 6 is 6.
    """
    b = blocks.select(key, F.col("idx").cast("long").alias("idx"), "kind", "level", "text")
    if marks is None:
        b = b.select("*", *[F.lit(0).cast("long").alias(n) for n in names])
    else:
        m = marks.select(F.col(key).alias("_k"), F.col("idx").cast("long").alias("_i"), *names)
        b = b.join(m, (F.col(key) == F.col("_k")) & (F.col("idx") == F.col("_i")), "left").drop("_k", "_i")
    by, up = Window.partitionBy(key), Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    values = {"blocks": F.lit(1), "characters": F.length(F.coalesce("text", F.lit(""))), **{n: F.coalesce(n, F.lit(0)) for n in names}}
    b = b.select(key, "idx", "kind", "level", "text", (F.max("idx").over(by) + 1).alias("_last"), *[x for n, v in values.items() for x in ((F.sum(v).over(up) - v).cast("long").alias(f"_b_{n}"), F.sum(v).over(by).cast("long").alias(f"_t_{n}"))])
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)).cast("int")
    h = b.filter("kind = 'heading'").withColumn("level", level)
    order = Window.partitionBy(key).orderBy("idx")
    h = h.withColumn("_n", F.row_number().over(order) - 1)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    own = lambda make: F.coalesce(*[F.when(F.col("level") == n, make(n)) for n in LEVELS])
    # totals only grow, so that the least total at a later heading of the level is the next one's
    following = lambda value: own(lambda n: F.min(F.when(F.col("level") <= n, value)).over(after))
    h = h.select("*", *[F.coalesce(F.max(F.when(F.col("level") == n, F.col("idx"))).over(before), F.lit(-1)).alias(f"_p{n}") for n in LEVELS])
    h = h.select("*", F.coalesce(following(F.col("idx")), F.col("_last")).alias("end_idx"), following(F.col("_n")).alias("_next"), F.count("*").over(Window.partitionBy(key)).alias("_all"), *[(F.coalesce(following(F.col(f"_b_{n}")), F.col(f"_t_{n}")) - F.col(f"_b_{n}")).alias(f"_s_{n}") for n in values])
    live = []
    for n in LEVELS:  # a heading above is open if none of a higher level came after it
        above = [F.col(f"_p{m}") for m in range(1, n)]
        open_ = (F.col(f"_p{n}") >= 0) & (F.col("level") > n)
        live.append(open_ & (F.col(f"_p{n}") > (F.greatest(*above) if len(above) > 1 else above[0])) if above else open_)
    depth = reduce(lambda x, y: x + y, [x.cast("int") for x in live])
    parent = F.greatest(*[F.when(x, F.col(f"_p{n}")) for n, x in zip(LEVELS, live)])
    size = F.coalesce("_next", "_all") - F.col("_n")
    h = h.withColumn("depth", depth).withColumn("lft", (2 * F.col("_n") - F.col("depth") + 1).cast("long"))
    return h.select(key, "idx", "level", F.trim("text").alias("title"), "depth", parent.alias("parent_idx"), "lft", (F.col("lft") + 2 * size - 1).cast("long").alias("rgt"), "end_idx", *[F.col(f"_s_{n}").alias(n) for n in values])


def figures(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, label, list (figure or table), nth of its list, idx, caption, section_idx (the heading before it; null without one)."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.select(key, "idx", "text", F.max(F.when(F.col("kind") == "heading", F.col("idx"))).over(before).alias("section_idx"), caption_label(F.col("text")).alias("label"))
    b = b.filter("label IS NOT NULL").withColumn("list", F.when(F.lower(F.left("label", F.lit(1))) == "t", "table").otherwise("figure"))
    nth = F.row_number().over(Window.partitionBy(key, "list").orderBy("idx")).cast("long")
    return b.select(key, "label", "list", nth.alias("nth"), "idx", F.trim("text").alias("caption"), "section_idx")
