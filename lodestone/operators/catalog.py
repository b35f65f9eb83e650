"""Library, views of one source, and changes to it, all for many sources at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like, strip
from ..schema import NOTE_TEMPLATE
from .blocks import latest_versions


def library(sources: DataFrame, knowledge: DataFrame, questions: DataFrame, source_tags: DataFrame, q: str | None = None, status: str | None = None, tag: str | None = None) -> DataFrame:
    """Sources with counts and tags, the last opened first (order_at; ties by id are left to the caller).

    Counts are aggregated before the joins; every join key is one row on the counted side.
    """
    s = sources
    if q:
        s = s.filter(F.coalesce(like(F.col("title"), q), F.lit(False)) | F.coalesce(like(F.col("authors"), q), F.lit(False)) | F.coalesce(like(F.col("one_line_summary"), q), F.lit(False)))
    if status:
        s = s.filter(F.col("reading_status") == status)
    if tag:
        s = s.join(source_tags.filter(F.col("name") == tag), F.col("id") == F.col("source_id"), "left_semi")
    k = knowledge.groupBy(F.col("source_id").alias("_k")).agg(F.count_if(F.col("origin") != "auto_extract").alias("knowledge_count"), F.count_if(F.col("info_type") == "open_question").alias("open_question_count"))
    n = questions.groupBy(F.col("source_id").alias("_q")).agg(F.count("*").alias("question_count"))
    t = source_tags.groupBy(F.col("source_id").alias("_t")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    j = s.join(k, F.col("id") == F.col("_k"), "left").join(n, F.col("id") == F.col("_q"), "left").join(t, F.col("id") == F.col("_t"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("id", "title", "reading_status", zero("knowledge_count"), zero("open_question_count"), zero("question_count"), F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("last_opened_at", "updated_at").alias("order_at"))


def tag_options(source_tags: DataFrame) -> DataFrame:
    return source_tags.select("name").distinct()


def note_view(sources: DataFrame, knowledge: DataFrame) -> DataFrame:
    """source_id, ord, key, label, items, n: every template section of a source, then its other sections."""
    w = Window.partitionBy("source_id", "section_key")
    rows = F.array_sort(F.collect_list(F.struct("sort_order", "created_at", "id")))
    g = knowledge.groupBy("source_id", "section_key").agg(F.array_join(F.transform(rows, lambda r: r["id"]), ",").alias("items"), F.count("*").alias("n"))
    template = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("label")) for k, v in NOTE_TEMPLATE])
    frame = sources.select(F.col("id").alias("sid"), F.posexplode(template).alias("ord", "x")).select("sid", "ord", "x.key", "x.label")
    own = frame.join(g, (F.col("sid") == F.col("source_id")) & (F.col("key") == F.col("section_key")), "left")
    own = own.select(F.col("sid").alias("source_id"), "ord", "key", "label", F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    extra = g.filter(~F.col("section_key").isin([k for k, _ in NOTE_TEMPLATE])).join(sources.select(F.col("id").alias("sid")), F.col("source_id") == F.col("sid"), "left_semi")
    extra = extra.select("source_id", F.lit(99).alias("ord"), F.col("section_key").alias("key"), F.col("section_key").alias("label"), "items", F.col("n").cast("long").alias("n"))
    return own.unionByName(extra)


def question_list(questions: DataFrame, answers: DataFrame, knowledge: DataFrame) -> DataFrame:
    """A row a question and answer (answers null where there is none), with saved: kept in the notes."""
    kept = knowledge.filter(F.col("answer_id").isNotNull()).select(F.col("question_id").alias("_q"), F.col("answer_id").alias("_a")).distinct()
    a = answers.select(F.col("id").alias("answer_id"), F.col("question_id").alias("qid"), "content", F.col("created_at").alias("answered_at"))
    j = questions.join(a, F.col("id") == F.col("qid"), "left").join(kept, (F.col("id") == F.col("_q")) & (F.col("answer_id") == F.col("_a")), "left")
    return j.select(F.col("id").alias("question_id"), "source_id", "question_text", "answer_id", F.col("content").alias("answer"), F.when(F.col("answer_id").isNotNull(), F.col("_a").isNotNull()).alias("saved"))


def document_view(versions: DataFrame, blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """The latest version's blocks with their translations, in order of idx."""
    v = latest_versions(versions).select(F.col("id").alias("vid"))
    t = translations.groupBy("source_id", "block_id").agg(F.max_by("translated_text", "updated_at").alias("translated_text"))
    t = t.select(F.col("source_id").alias("_s"), F.col("block_id").alias("_b"), "translated_text")
    b = blocks.join(v, F.col("version_id") == F.col("vid"))
    return b.join(t, (F.col("source_id") == F.col("_s")) & (F.col("id") == F.col("_b")), "left").select("source_id", "version_id", "idx", "kind", "text", "translated_text")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the sources in gone (id)."""
    ids = gone.select(F.col("id").alias("_gone"))
    return {name: df.join(ids, F.col("id" if name == "sources" else "source_id") == F.col("_gone"), "left_anti") for name, df in tables.items()}


def patched(rows: DataFrame, patches: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Rows with the non-null fields of their patch (one a key); fields left out stay."""
    p = patches.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = rows.join(p, F.col(key) == F.col("_key"), "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def patched_items(items: DataFrame, patches: DataFrame) -> DataFrame:
    """Note items after partial updates; a content patch on an llm item makes it llm_edited, equal or not."""
    fields = ["section_key", "title", "content", "info_type", "verification"]
    touched = patches.filter(F.col("content").isNotNull()).select(F.col("id").alias("_t"))
    j = patched(items, patches, fields).join(touched, F.col("id") == F.col("_t"), "left")
    origin = F.when((F.col("origin") == "llm") & F.col("_t").isNotNull(), "llm_edited").otherwise(F.col("origin"))
    return j.withColumn("origin", origin).drop("_t")


def retagged(source_tags: DataFrame, patches: DataFrame) -> DataFrame:
    """source_id, name after replacing the tags of the patched sources: trimmed, unique, no blanks."""
    ids = patches.select(F.col("source_id").alias("_p"))
    kept = source_tags.join(ids, F.col("source_id") == F.col("_p"), "left_anti").select("source_id", "name")
    names = F.array_distinct(F.filter(F.transform("tags", strip), lambda t: t != ""))
    return kept.unionByName(patches.select("source_id", F.explode(names).alias("name")))


def next_order(items: DataFrame, new: DataFrame) -> DataFrame:
    """New items with sort_order behind the last of their source and section, in the order of seq."""
    last = items.groupBy(F.col("source_id").alias("_s"), F.col("section_key").alias("_k")).agg(F.max("sort_order").alias("last"))
    n = F.row_number().over(Window.partitionBy("source_id", "section_key").orderBy("seq"))
    j = new.withColumn("_n", n).join(last, (F.col("source_id") == F.col("_s")) & (F.col("section_key") == F.col("_k")), "left")
    return j.withColumn("sort_order", F.coalesce("last", F.lit(0.0)) + F.col("_n")).drop("_s", "_k", "last", "_n")


def neighbours(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with prev_id and next_id in their list."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select("*", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def translated(blocks: DataFrame, cache: DataFrame, translate: Column) -> DataFrame:
    """source_id, block_id, translated_text, cached: from the cache, else by ``translate`` for the misses alone."""
    c = cache.groupBy(F.col("source_id").alias("_s"), F.col("block_id").alias("_b")).agg(F.max_by("translated_text", "updated_at").alias("hit"))
    j = blocks.join(c, (F.col("source_id") == F.col("_s")) & (F.col("block_id") == F.col("_b")), "left")
    return j.select("source_id", "block_id", F.when(F.col("hit").isNotNull(), F.col("hit")).otherwise(translate).alias("translated_text"), F.col("hit").isNotNull().alias("cached"))


def next_verification(v: Column) -> Column:
    return F.when(v == "unverified", "verified").when(v == "verified", "disputed").otherwise("unverified")


def opened(log: DataFrame) -> DataFrame:
    """source_id, last_opened_at from a log of events (source_id, action, at): the latest opening, or nothing."""
    return log.filter("action = 'open'").groupBy("source_id").agg(F.max("at").alias("last_opened_at"))


def living_highlights(log: DataFrame) -> DataFrame:
    """id, source_id, block_id, color, comment, created_at of the highlights that are there now.

    log: id, source_id, block_id, action (add, edit, delete), color, comment, at, seq. The last event of a highlight (by
    at, then seq) decides whether it lives; an edit's null color or comment leaves what was.
    """
    order = F.struct("at", "seq")
    kept = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    g = log.groupBy("id").agg(F.max_by("action", order).alias("last"), F.min_by("source_id", order).alias("source_id"), F.min_by("block_id", order).alias("block_id"), kept("color").alias("color"), kept("comment").alias("comment"), F.min("at").alias("created_at"))
    return g.filter("last <> 'delete'").drop("last")


def highlighted_view(view: DataFrame, highlights: DataFrame) -> DataFrame:
    """document_view() rows (with id, the block's) and their living highlights: an array of id, color, comment in the order of their making."""
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id", "color", "comment")))
    h = highlights.groupBy(F.col("block_id").alias("_b")).agg(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["color"].alias("color"), r["comment"].alias("comment"))).alias("highlights"))
    j = view.join(h, F.col("id") == F.col("_b"), "left").drop("_b")
    return j.withColumn("highlights", F.coalesce("highlights", F.array().cast("array<struct<id:string,color:string,comment:string>>")))
