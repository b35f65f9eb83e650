"""The given tables as sources, blocks, notes, questions and answers. The mapping is ours.

Ids are texts: d<doc_id> for documents, w<page_id> for pages, k<doc_id> for note items made of
labels, c<conv_id>-<turn> for questions and answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import table

STARTED = "2024-01-01T00:00:00+00:00"


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def sources(spark: SparkSession, sf: str, activity: bool = True) -> DataFrame:
    """Documents as text sources: the title is the first line's beginning, the summary the text's."""
    d = table(spark, sf, "documents")
    status = F.element_at(F.array(*map(F.lit, ["unread", "reading", "read", "recheck"])), (F.col("doc_id") % 4 + 1).cast("int"))
    s = d.select(
        "doc_id",
        _id("d", "doc_id").alias("id"),
        F.lit("text").alias("type"),
        F.left(F.substring_index("text", "\n", 1), F.lit(80)).alias("title"),
        F.concat(F.lit('["'), "source", F.lit('"]')).alias("authors"),
        F.lit(None).cast("int").alias("year"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("arxiv_id"),
        "lang",
        F.sha2("text", 256).alias("content_hash"),
        status.alias("reading_status"),
        F.left("text", F.lit(150)).alias("one_line_summary"),
        F.lit(STARTED).alias("created_at"),
        F.lit(STARTED).alias("updated_at"),
    )
    if not activity:
        return s.withColumn("last_opened_at", F.lit(None).cast("string"))
    e = table(spark, sf, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("_u")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_opened_at"))
    return s.join(e, F.col("doc_id") == F.col("_u"), "left").drop("_u")


def source_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(_id("d", "doc_id").alias("source_id"), F.explode(F.array("source", "lang")).alias("name"))


def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as note items: good documents are the user's own, toxic ones open questions."""
    j = table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(120)).alias("content")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("_d"), "quality", "toxic"), F.col("doc_id") == F.col("_d"))
    open_ = F.col("toxic") == 1
    return j.select(
        _id("k", "doc_id").alias("id"),
        # every ten documents share a source's note, so that sections hold several items
        F.concat(F.lit("d"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string")).alias("source_id"),
        F.when(open_, "questions").when(F.col("doc_id") % 3 == 0, "method").when(F.col("doc_id") % 3 == 1, "insights").otherwise("own thoughts").alias("section_key"),
        F.when(F.col("doc_id") % 2 == 0, F.left("content", F.lit(30))).alias("title"),
        "content",
        F.when(F.col("quality") == 1, "user").otherwise("auto_extract").alias("origin"),
        F.when(open_, "open_question").otherwise("fact").alias("info_type"),
        F.lit("unverified").alias("verification"),
        F.lit(None).cast("string").alias("anchor"),
        F.lit(None).cast("string").alias("question_id"),
        F.lit(None).cast("string").alias("answer_id"),
        F.col("doc_id").cast("double").alias("sort_order"),
        F.lit(STARTED).alias("created_at"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("updated_at"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns, asked of the document with the conversation's number."""
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select(
        F.concat(_id("c", "conv_id"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        _id("d", "conv_id").alias("source_id"),
        F.col("text").alias("question_text"),
        F.lit(None).cast("string").alias("anchor"),
        F.lit(None).cast("string").alias("selection_text"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns, each to the latest user turn before it in its conversation."""
    c = table(spark, sf, "conversations").filter("role <> 'system'")
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.select("conv_id", "turn", "role", "text", asked.alias("asked")).filter("role = 'assistant' AND asked IS NOT NULL")
    return c.select(
        F.concat(_id("c", "conv_id"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat(_id("c", "conv_id"), F.lit("-"), F.col("asked").cast("string")).alias("question_id"),
        F.col("text").alias("content"),
        F.lit("mock").alias("model"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"),
    )


def blocks(spark: SparkSession, sf: str, last: bool = False) -> DataFrame:
    """Lines of documents as blocks (these texts are single paragraphs, so lines serve as blocks); last: with the idx of each document's last line."""
    lines = F.split("text", "\n", -1)
    ends = [(F.size(lines) - 1).cast("long").alias("last")] if last else []
    d = table(spark, sf, "documents").select("doc_id", *ends, F.posexplode(lines).alias("idx", "text"))
    return d.select("doc_id", *["last"] * last, _id("v", "doc_id").alias("version_id"), F.col("idx").cast("long").alias("idx"), F.when(F.col("idx") % 7 == 0, "heading").otherwise("para").alias("kind"), F.when(F.col("idx") % 7 == 0, F.col("idx") % 3 + 1).cast("int").alias("level"), "text")


def markdown_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with Markdown marks put before their lines, so that every kind of block occurs."""
    d = table(spark, sf, "documents")
    marks = F.array(*map(F.lit, ["# ", "", "## ", "- ", "> ", "", "1. ", "### "]))
    text = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.element_at(marks, ((i + F.col("doc_id")) % 8 + 1).cast("int")), x, F.when(i % 5 == 4, "\n\n```\ncode " + "x\n```").otherwise(""))), "\n")
    return d.select("doc_id", text.alias("text"))
