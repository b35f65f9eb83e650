"""First analysis of a document without a language model, and where its results are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line, new_id
from ..schema import DEFAULT_TARGET, FIELD_SECTIONS, HEURISTIC_QUESTION, OUTLINE_LABEL, SAVE_TARGETS


def heuristic(docs: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, one_line_summary, background, method, open_question from the first 200 blocks. docs: key, title."""
    b = blocks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("idx"))).filter("_n <= 200")
    para = F.when((F.col("kind") == "para") & (F.length("text") > 80), F.col("idx"))
    heads = F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "heading", F.struct("idx", "text")))), 1, 12)
    g = b.groupBy(F.col(key).alias("_k")).agg(F.min_by("text", para).alias("para"), F.transform(heads, lambda h: h["text"]).alias("heads"))
    j = docs.select(key, "title").join(g, F.col(key) == F.col("_k"), "left")
    outline = F.when(F.size("heads") > 0, F.concat(F.lit(OUTLINE_LABEL), F.array_join("heads", " / ")))
    summary = F.when(F.col("para").isNotNull(), F.concat(F.left("para", F.lit(150)), F.lit("…"))).otherwise(F.col("title"))
    return j.select(key, summary.alias("one_line_summary"), F.col("para").alias("background"), outline.alias("method"), F.lit(HEURISTIC_QUESTION).alias("open_question"))


def stored(items: DataFrame, extracted: DataFrame) -> DataFrame:
    """Note items after an analysis: earlier auto_extract items of the analysed sources are replaced.

    extracted: source_id and what it has of background, method, experiments, novelty, limitations,
    terms (array of term, definition) and open_questions (array). Empty values make no item.
    """
    have = extracted.columns
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    row = lambda s, t, title, content: F.struct(F.lit(s).alias("section_key"), F.lit(t).alias("info_type"), title.cast("string").alias("title"), content.cast("string").alias("content"))
    null = F.lit(None)
    fields = F.filter(F.array(*[row(f, "llm_summary", null, text(f)) for f in FIELD_SECTIONS]), lambda x: x["content"] != "")
    terms = F.col("terms") if "terms" in have else F.array().cast("array<struct<term:string,definition:string>>")
    terms = F.transform(F.filter(terms, lambda t: t["term"] != ""), lambda t: row("terms", "term", t["term"], F.coalesce(t["definition"], F.lit(""))))
    asked = F.col("open_questions") if "open_questions" in have else F.array().cast("array<string>")
    asked = F.transform(F.filter(asked, lambda q: q != ""), lambda q: row("questions", "open_question", null, q))
    e = extracted.select("source_id", F.posexplode(F.concat(fields, terms, asked)).alias("n", "x"))
    new = e.select(
        new_id(F.lit("auto"), F.col("source_id"), (F.col("n") + 1).cast("string")).alias("id"),
        "source_id",
        "x.section_key",
        "x.title",
        "x.content",
        F.lit("auto_extract").alias("origin"),
        "x.info_type",
        (F.col("n") + 1).cast("double").alias("sort_order"),
    )
    ids = extracted.select(F.col("source_id").alias("_s")).distinct()
    old = items.filter(F.col("origin") == "auto_extract").join(ids, F.col("source_id") == F.col("_s"), "left_semi").select(F.col("id").alias("_old"))
    kept = items.join(old, F.col("id") == F.col("_old"), "left_anti")
    return kept.select(*new.columns).unionByName(new)


def save_target(answers: DataFrame) -> DataFrame:
    """answer_id, section_key, info_type, title: where an answer is kept, from the kind of prompt. answers: answer_id, prompt_type, content."""
    section, info = F.lit(DEFAULT_TARGET[0]), F.lit(DEFAULT_TARGET[1])
    for kind, (s, i) in SAVE_TARGETS.items():
        section = F.when(F.col("prompt_type") == kind, s).otherwise(section)
        info = F.when(F.col("prompt_type") == kind, i).otherwise(info)
    return answers.select("answer_id", section.alias("section_key"), info.alias("info_type"), F.left(first_line(F.col("content")), F.lit(30)).alias("title"))


def adopted(suggested: DataFrame, sections: list[str], infos: list[str]) -> DataFrame:
    """Suggestions where the user has not chosen: id, section_key, info_type, title.

    suggested: id, user_section, user_info, user_title, section_key, info_type, title, and defaults.
    """
    def pick(user, value, allowed, default):
        return F.coalesce(F.col(user), F.when(F.col(value).isin(allowed), F.col(value)), F.lit(default))

    title = F.when(F.coalesce("user_title", F.lit("")) != "", F.col("user_title")).otherwise(F.col("title"))
    return suggested.select("id", pick("user_section", "section_key", sections, DEFAULT_TARGET[0]).alias("section_key"), pick("user_info", "info_type", infos, DEFAULT_TARGET[1]).alias("info_type"), title.alias("title"))
