"""Export: lossless JSON and readable Markdown, one document a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HISTORY_TITLE, INFO_LABELS, NOTE_TEMPLATE, ORIGIN_LABELS, labelled


def nested(sources: DataFrame, parts: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """id, json: every source with its parts, each an array in its own order, in one pass a part.

    parts: name -> (table, key column, columns to order by).
    """
    out = sources.select(F.col("id"), F.struct(*sources.columns).alias("source"))
    for name, (df, key, order) in parts.items():
        row = F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("v"))
        g = df.groupBy(F.col(key).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias(name))
        out = out.join(g, F.col("id") == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.array()))
    return out.select("id", F.to_json(F.struct("source", *parts), {"ignoreNullFields": "false"}).alias("json"))


#: Parts of a full export beside the source itself: name, and what each is ordered by.
PARTS = {"versions": ["fetched_at", "id"], "blocks": ["idx", "id"], "questions": ["created_at", "id"], "answers": ["created_at", "id"], "knowledge_items": ["sort_order", "created_at", "id"], "highlights": ["created_at", "id"], "translations": ["block_id"]}


def full(sources: DataFrame, tags: DataFrame, **parts: DataFrame) -> DataFrame:
    """id, json: every source with all nine parts; a part that isn't given is empty.

    parts: tables by the names of PARTS, each with source_id; answers name their question, and go with
    its source. tags: source_id, name, listed by name alone.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    if "answers" in parts:
        asked = parts["questions"].select(F.col("id").alias("_q"), F.col("source_id").alias("_source"))
        parts["answers"] = parts["answers"].join(asked, F.col("question_id") == F.col("_q")).drop("_q")
    names = tags.groupBy(F.col("source_id").alias("_t")).agg(F.array_sort(F.collect_set("name")).alias("_tags"))
    out = sources.select(F.col("id"), F.struct(*sources.columns).alias("source")).join(names, F.col("id") == F.col("_t"), "left").drop("_t")
    columns = [F.col("source")]
    for name, order in PARTS.items():
        if name not in parts:
            columns.append(F.array().cast("array<string>").alias(name))
            continue
        df, key = parts[name], "_source" if name == "answers" else "source_id"
        row = F.struct(F.struct(*[F.col(c) for c in order if c in df.columns]).alias("o"), F.struct(*[c for c in df.columns if c != "_source"]).alias("v"))
        g = df.groupBy(F.col(key).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias(name))
        out = out.join(g, F.col("id") == F.col("_k"), "left").drop("_k")
        columns.append(F.coalesce(name, F.array()).alias(name))
    columns.append(F.coalesce("_tags", F.array()).alias("tags"))
    return out.select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def envelopes(exported: DataFrame, at: Column | None = None) -> DataFrame:
    """value: one line of JSON a source, with the time of the export; to be written as text.

    All sources in one JSON document would be one row without a bound.
    """
    at = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return exported.select(F.concat(F.lit('{"exported_at":'), F.to_json(F.array(at)).substr(F.lit(2), F.length(F.to_json(F.array(at))) - 2), F.lit(',"source":'), "json", F.lit("}")).alias("value"))


def anchor_line(anchor: Column, indent: str = "") -> Column:
    """Page, heading and quote of an anchor (JSON) in one line; null if it has none."""
    a = F.from_json(anchor, "page int, headingPath string, quote string")
    quote = F.when(F.length(a["quote"]) > 80, F.concat(F.lit("“"), F.left(a["quote"], F.lit(80)), F.lit("…”"))).otherwise(F.concat(F.lit("“"), a["quote"], F.lit("”")))
    parts = F.filter(
        F.array(F.when(a["page"] != 0, F.concat(F.lit("p."), a["page"].cast("string"))), F.when(a["headingPath"] != "", a["headingPath"]), F.when(a["quote"] != "", quote)),
        lambda p: p.isNotNull(),
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit(indent + "- _原文: "), F.array_join(parts, " | "), F.lit("_")))


def item_lines(indented: str = "\n  ") -> Column:
    """The lines of one note item, the last one empty."""
    head = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("**"), "title", F.lit("** — "))).otherwise(F.lit(""))
    body = F.replace(F.concat(F.lit("- "), head, F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit(indented))
    checked = F.when(F.coalesce("verification", F.lit("unverified")).isin("", "unverified"), F.lit("")).otherwise(F.concat(F.lit(" / 検証: "), "verification"))
    meta = F.concat(F.lit("  - _出所: "), labelled(F.col("origin"), ORIGIN_LABELS), F.lit(" / 種別: "), labelled(F.col("info_type"), INFO_LABELS), checked, F.lit("_"))
    parts = F.filter(F.array(body, meta, anchor_line(F.col("anchor"), "  "), F.lit("")), lambda x: x.isNotNull())
    return F.array_join(parts, "\n")


def markdown(sources: DataFrame, knowledge: DataFrame, questions: DataFrame, answers: DataFrame, source_tags: DataFrame) -> DataFrame:
    """id, markdown of every source: front matter, summary, sections in template order, questions and answers."""
    known = {k: i for i, (k, _) in enumerate(NOTE_TEMPLATE)}
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("section_key")], F.lit(len(known)))
    k = knowledge.select("source_id", order.alias("ord"), "section_key", "sort_order", "created_at", "id", item_lines().alias("lines"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "created_at", "id", "lines"))), lambda r: r["lines"]), "\n")
    sec = k.groupBy("source_id", "ord", "section_key").agg(items.alias("items"))
    title = labelled(F.col("section_key"), dict(NOTE_TEMPLATE))
    sec = sec.select("source_id", F.struct("ord", "section_key", F.concat(F.lit("## "), title, F.lit("\n\n"), "items").alias("text")).alias("s"))
    sec = sec.groupBy(F.col("source_id").alias("_s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda r: r["text"]), "\n").alias("sections"))
    a = answers.select(F.col("question_id").alias("_qid"), F.col("id").alias("aid"), F.col("content").alias("answer"), "model")
    q = questions.join(a, F.col("id") == F.col("_qid"), "left")
    reply = F.when(F.coalesce("answer", F.lit("")) != "", F.concat(F.lit("**A** _(AI回答 / "), F.coalesce(F.nullif("model", F.lit("")), F.lit("?")), F.lit(")_:\n\n"), "answer"))
    chosen = F.when(F.coalesce("selection_text", F.lit("")) != "", F.concat(F.lit("> "), F.left("selection_text", F.lit(300))))
    block = F.array_join(F.filter(F.array(F.concat(F.lit("### Q: "), "question_text"), anchor_line(F.col("anchor")), chosen, F.lit(""), reply, F.lit("")), lambda x: x.isNotNull()), "\n")
    q = q.select("source_id", F.struct("created_at", "id", "aid", block.alias("text")).alias("b"))
    q = q.groupBy(F.col("source_id").alias("_h")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda r: r["text"]), "\n").alias("history"))
    t = source_tags.groupBy(F.col("source_id").alias("_t")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("tags"))
    j = sources.join(sec, F.col("id") == F.col("_s"), "left").join(q, F.col("id") == F.col("_h"), "left").join(t, F.col("id") == F.col("_t"), "left")
    authors = F.array_join(F.from_json("authors", "array<string>"), ", ")
    fm = [("title", F.col("title")), ("type", F.col("type"))]
    lines = [F.when(v != "", F.concat(F.lit(n + ": "), v)) for n, v in fm]
    lines.append(F.when(authors != "", F.concat(F.lit("authors: ["), authors, F.lit("]"))))
    for n in ("year", "url", "doi", "arxiv_id"):
        v = F.col(n).cast("string")
        lines.append(F.when(v != "", F.concat(F.lit(n + ": "), v)))
    lines.append(F.when(F.col("tags") != "", F.concat(F.lit("tags: ["), "tags", F.lit("]"))))
    for n, c in (("reading_status", "reading_status"), ("created", "created_at"), ("updated", "updated_at")):
        lines.append(F.when(F.col(c) != "", F.concat(F.lit(n + ": "), c)))
    front = F.array_join(F.filter(F.array(F.lit("---"), *lines, F.lit("---")), lambda x: x.isNotNull()), "\n")
    summary = F.when(F.coalesce("one_line_summary", F.lit("")) != "", F.concat(F.lit("> **一言要約**: "), "one_line_summary", F.lit("\n")))
    history = F.when(F.col("history").isNotNull(), F.concat(F.lit("## " + HISTORY_TITLE + "\n\n"), "history"))
    body = F.array_join(F.filter(F.array(front, F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), summary, F.col("sections"), history), lambda x: x.isNotNull()), "\n")
    return j.select("id", F.concat(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))
