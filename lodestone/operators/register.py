"""Registering documents: inputs to sources, versions and blocks, with what is refused and what is known.

Ids come from natural keys, so that a rerun makes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import new_id, strip
from .blocks import block_ids, heading_paths
from .dedup import find_duplicates
from .parse import markdown_blocks, parsed_pages, titles

_KEYS = ["content_hash", "doi", "arxiv_id", "url", "canonical_url"]


@dataclass
class Registered:
    """sources, versions and blocks to be written in this order; refused: key, reason."""

    sources: DataFrame
    versions: DataFrame
    blocks: DataFrame
    refused: DataFrame


def _finish(known: DataFrame | None, rows: DataFrame, blocks: DataFrame | None, bad: DataFrame, key: str, force: bool, at: Column) -> Registered:
    """The tables to write; blocks is None where rows hold them as an array."""
    for c in (*_KEYS, "lang", "site_name", "published_at"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("id", new_id(F.col("type"), F.col(key).cast("string"), F.col("content_hash")))
    if known is not None and not force:
        twins = find_duplicates(rows.select("id", *_KEYS), known.select("id", *_KEYS)).select(F.col("id").alias("_twin")).distinct()
        again = rows.join(twins, F.col("id") == F.col("_twin"), "left_semi")
        bad = bad.unionByName(again.select(F.col(key).cast("string").alias("key"), F.lit("duplicate").alias("reason")))
        rows = rows.join(twins, F.col("id") == F.col("_twin"), "left_anti")
    sources = rows.select("id", "type", "title", *_KEYS, "lang", "site_name", "published_at", F.lit("unread").alias("reading_status"), F.lit("pending").alias("analysis_status"), at.alias("created_at"), at.alias("updated_at"))
    versions = rows.select(F.concat("id", F.lit("-1")).alias("id"), F.col("id").alias("source_id"), F.lit(1).alias("seq"), at.alias("fetched_at"), "content_hash")
    if blocks is None:
        b = rows.select(F.col("id").alias("source_id"), F.inline("blocks"))
    else:
        b = blocks.join(rows.select(F.col(key).alias("_k"), F.col("id").alias("source_id")), F.col(key) == F.col("_k")).drop("_k")
    b = b.withColumn("version_id", F.concat("source_id", F.lit("-1")))
    b = block_ids(heading_paths(b, "version_id"))
    return Registered(sources, versions, b.select("id", "version_id", "source_id", "idx", "kind", "level", "text", "heading_path"), bad)


def texts(inputs: DataFrame, known: DataFrame | None = None, force: bool = False, at: Column | None = None, key: str = "doc_id") -> Registered:
    """Plain text and Markdown. inputs: key, content, filename, title (the last two may be null).

    Blank contents are refused; the type is markdown for names that end in .md or .markdown; the
    hash is that of the raw content; a given title goes before that of the text.
    """
    at = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    blank = strip(F.coalesce("content", F.lit(""))) == ""
    bad = inputs.filter(blank).select(F.col(key).cast("string").alias("key"), F.lit("empty").alias("reason"))
    good = inputs.filter(~blank)
    blocks = markdown_blocks(good, key, "content")
    found = titles(good, blocks, key, "filename").select(F.col(key).alias("_t"), F.col("title").alias("found"))
    name = F.coalesce("filename", F.lit(""))
    kind = F.when(F.endswith(name, F.lit(".md")) | F.endswith(name, F.lit(".markdown")), "markdown").otherwise("text")
    rows = good.join(found, F.col(key) == F.col("_t")).select(key, kind.alias("type"), F.coalesce(F.nullif("title", F.lit("")), "found").alias("title"), F.sha2("content", 256).alias("content_hash"))
    return _finish(known, rows, blocks, bad, key, force, at)


def pages(inputs: DataFrame, known: DataFrame | None = None, force: bool = False, at: Column | None = None, key: str = "page_id") -> Registered:
    """Web pages that were fetched: key, url, html. Only http and https; the hash is that of the blocks' text.

    Each page is parsed once, in one row with its blocks; repeated pages are one source.
    """
    at = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    fine = F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    bad = inputs.filter(~fine).select(F.col(key).cast("string").alias("key"), F.lit("not a web address").alias("reason"))
    good = inputs.filter(fine)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    rows = parsed_pages(good, key).withColumn("content_hash", F.sha2(text, 256)).withColumn("type", F.lit("web"))
    # a page that is given twice is one source
    rows = rows.dropDuplicates([key, "content_hash"])
    return _finish(known, rows, None, bad, key, force, at)


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a PDF does."""
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


