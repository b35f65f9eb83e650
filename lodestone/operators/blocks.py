"""Sequences of blocks: heading paths, ids, sections, captions, excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXCERPT_GAP

LEVELS = range(1, 7)


def heading_paths(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with heading_path: the running headings, 'A > B'. Exact.

    A level's last heading is in force if it came after the last heading of every higher level; one
    window pass computes the last position and text of each level.
    """
    w = Window.partitionBy(key).orderBy("idx")
    level = F.when(F.col("kind") == "heading", F.when(F.coalesce("level", F.lit(0)) == 0, 1).otherwise(F.col("level")))
    cols = []
    for n in LEVELS:
        at = level == n
        cols.append(F.coalesce(F.max(F.when(at, F.col("idx"))).over(w), F.lit(-1)).alias(f"_p{n}"))
        cols.append(F.last(F.when(at, F.trim("text")), ignorenulls=True).over(w).alias(f"_t{n}"))
    marked = blocks.select("*", *cols)
    parts = []
    for n in LEVELS:
        above = [F.col(f"_p{m}") for m in range(1, n)]
        live = F.col(f"_p{n}") >= 0
        if above:
            live &= F.col(f"_p{n}") > (F.greatest(*above) if len(above) > 1 else above[0])
        parts.append(F.when(live, F.col(f"_t{n}")))
    return marked.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*[f"_{c}{n}" for n in LEVELS for c in "pt"])


def block_ids(blocks: DataFrame, version: str = "version_id") -> DataFrame:
    """blocks with id: from version, content and how often that content came before. Property parity."""
    have = blocks.columns
    page = F.col("page").cast("string") if "page" in have else F.lit("")
    role = F.col("role") if "role" in have else F.lit("")
    bbox = F.col("bbox_json") if "bbox_json" in have else F.lit("")
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("kind"), F.col("text"), page, role, bbox)]
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    nth = F.row_number().over(Window.partitionBy(version, "_digest").orderBy("idx")) - 1
    marked = blocks.withColumn("_digest", digest).withColumn("_nth", nth)
    return marked.withColumn("id", F.sha2(F.concat_ws(":", F.col(version), "_digest", F.col("_nth").cast("string")), 256)).drop("_digest", "_nth")


def doc_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: the blocks' texts in order, joined by line ends."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with section_path, section_no, section_id, parent_path, reference_id, candidate_label."""
    path = F.coalesce(F.nullif("heading_path", F.lit("")), F.lit("(front matter)"))
    b = blocks.withColumn("section_path", path)
    b = b.withColumn("_first", F.min("idx").over(Window.partitionBy(key, "section_path")))
    no = F.dense_rank().over(Window.partitionBy(key).orderBy("_first"))
    ref = F.row_number().over(Window.partitionBy(key).orderBy("idx"))
    b = b.select("*", no.alias("section_no"), ref.alias("_ref"))
    parent = F.when(F.instr("section_path", " > ") > 0, F.regexp_replace("section_path", "(?s) > (?:(?! > ).)*$", "")).otherwise(F.lit(""))
    return b.select(
        *[c for c in b.columns if c not in ("_first", "_ref")],
        F.concat(F.lit("S"), F.lpad(F.col("section_no").cast("string"), 4, "0")).alias("section_id"),
        F.concat(F.lit("B"), F.lpad(F.col("_ref").cast("string"), 6, "0")).alias("reference_id"),
        parent.alias("parent_path"),
        caption_label(F.col("text")).alias("candidate_label"),
    )


def caption_label(text):
    """Figure 3 or Table 2a at a block's beginning; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(text), r"(?i)^(?:Figure|Fig\.|Table)\s*(?:\d+[A-Za-z]?)\b", 0), F.lit(""))


def excerpt(blocks: DataFrame, key: str = "doc_id", most: int = 24000) -> DataFrame:
    """key, excerpt: blocks from the start within 80 % of ``most`` characters, then the last eight in budget.

    The head stops at the first block that overflows: running sums only grow, so that is a filter. The
    tail joins only documents of more than 16 blocks and may repeat what the head has.
    """
    t = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    by = Window.partitionBy(key)
    b = blocks.select(key, "idx", t.alias("t"))
    b = b.select(key, "idx", "t", F.length("t").alias("n"), F.count("*").over(by).alias("blocks"), F.row_number().over(by.orderBy(F.desc("idx"))).alias("back"), F.sum(F.length("t")).over(by.orderBy("idx")).alias("upto"))
    b = b.withColumn("head", F.col("upto") <= int(most * 0.8))
    b = b.withColumn("used", F.coalesce(F.max(F.when(F.col("head"), F.col("upto"))).over(by), F.lit(0)))
    tail = F.when(F.col("back") <= 8, F.col("n")).otherwise(0)
    b = b.withColumn("tail", (F.col("back") <= 8) & (F.col("used") + F.sum(tail).over(by.orderBy("idx")) <= most) & (F.col("blocks") > 16))
    rows = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("idx", "t")))), lambda r: r["t"])
    g = b.groupBy(key).agg(rows("head").alias("head"), rows("tail").alias("tail"))
    gap = F.when(F.size("tail") > 0, F.array(F.lit(EXCERPT_GAP))).otherwise(F.array().cast("array<string>"))
    return g.select(key, F.array_join(F.concat("head", gap, "tail"), "\n\n").alias("excerpt"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each source; equal times by seq."""
    w = Window.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("seq"))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
