"""Substring search across sources, notes, questions and answers, and inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hay, like, norm_ws, snippet


def cross_search(sources: DataFrame, knowledge: DataFrame, questions: DataFrame, answers: DataFrame, q: str, most: int = 50) -> DataFrame:
    """kind_rank, kind, source_id, source_title, snippet, ref_id: the first ``most`` hits, kind by kind.

    Filters stand before the joins, and each join brings a title to the rows that hit.
    """
    q = q.strip()
    s = sources.select(F.col("id").alias("sid"), F.col("title").alias("source_title"))
    hit = lambda *cols: F.coalesce(like(cols[0], q), F.lit(False)) | (F.coalesce(like(cols[1], q), F.lit(False)) if len(cols) > 1 else F.lit(False))

    def out(df: DataFrame, rank: int, kind: str, text) -> DataFrame:
        return df.select(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), "source_id", "source_title", snippet(text, q).alias("snippet"), "ref_id")

    a = sources.filter(hit(F.col("title"), F.col("one_line_summary")))
    a = out(a.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.col("id").alias("ref_id"), "title", "one_line_summary"), 0, "source", hay(F.col("title"), F.col("one_line_summary"), q))
    k = knowledge.filter(hit(F.col("title"), F.col("content"))).select("source_id", F.col("id").alias("ref_id"), "title", "content")
    k = out(k.join(s, F.col("source_id") == F.col("sid")), 1, "knowledge", hay(F.col("title"), F.col("content"), q))
    n = questions.filter(hit(F.col("question_text"))).select("source_id", F.col("id").alias("ref_id"), "question_text")
    n = out(n.join(s, F.col("source_id") == F.col("sid")), 2, "question", F.coalesce("question_text", F.lit("")))
    r = answers.filter(hit(F.col("content"))).select(F.col("id").alias("ref_id"), "question_id", "content")
    r = r.join(questions.select(F.col("id").alias("qid"), "source_id"), F.col("question_id") == F.col("qid")).join(s, F.col("source_id") == F.col("sid"))
    r = out(r, 3, "answer", F.coalesce("content", F.lit("")))
    every = a.unionByName(k).unionByName(n).unionByName(r)
    if not q:
        return every.limit(0)
    return every.orderBy("kind_rank", "ref_id").limit(most)


def in_document(blocks: DataFrame, q: str, key: str = "doc_id") -> DataFrame:
    """key, idx, hit, next_idx, prev_idx: blocks that hold q (any case, white space equal); next and previous cycle."""
    wanted = " ".join(q.split()).lower()
    hits = blocks.filter(F.contains(F.lower(norm_ws(F.col("text"))), F.lit(wanted)))
    w = Window.partitionBy(key).orderBy("idx")
    every = Window.partitionBy(key)
    return hits.select(
        key,
        "idx",
        F.row_number().over(w).cast("long").alias("hit"),
        F.coalesce(F.lead("idx").over(w), F.min("idx").over(every)).alias("next_idx"),
        F.coalesce(F.lag("idx").over(w), F.max("idx").over(every)).alias("prev_idx"),
    )
