"""Bounded context for answers: surrounding blocks, note digests, block selection under a budget."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_NOTES, NOTE_TEMPLATE, labelled

# Budgets in characters of canonical JSON.
BUDGETS = {"classify": 14000, "extract": 48000}
RESERVED = {"classify": 0, "extract": 2000}
MOST_TEXT = 2000
FIRST = {"classify": "(?i)abstract|front matter", "extract": "(?i)abstract|introduction|method|approach|model|architecture|experiment|evaluat|result|benchmark|dataset|ablation|limit|discussion|conclu|reproduc|implementation"}


def surrounding(blocks: DataFrame, key: str = "doc_id", around: int = 2, most: int = 8000) -> DataFrame:
    """key, idx, before, after, heading_path for every block: texts of the blocks around it, each half bounded."""
    w = Window.partitionBy(key).orderBy("idx")
    half = most // 2
    before = F.array_join(F.collect_list("text").over(w.rangeBetween(-around, -1)), "\n")
    after = F.array_join(F.collect_list("text").over(w.rangeBetween(1, around)), "\n")
    heading = F.coalesce("heading_path", F.lit("")) if "heading_path" in blocks.columns else F.lit("")
    return blocks.select(key, "idx", F.right(before, F.lit(half)).alias("before"), F.left(after, F.lit(half)).alias("after"), heading.alias("heading_path"))


def note_digest(sources: DataFrame, knowledge: DataFrame, most: int = 12) -> DataFrame:
    """source_id, digest: the newest items of all sections, one line each."""
    w = Window.partitionBy("source_id").orderBy(F.desc("updated_at"), F.desc("id"))
    k = knowledge.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    body = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("content"))
    line = F.concat(F.lit("- ["), labelled(F.col("section_key"), dict(NOTE_TEMPLATE)), F.lit("] "), F.replace(F.left(body, F.lit(120)), F.lit("\n"), F.lit(" ")))
    g = k.select("source_id", F.struct("n", line.alias("line")).alias("x")).groupBy(F.col("source_id").alias("_s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["line"]), "\n").alias("digest"))
    return sources.select(F.col("id").alias("source_id")).join(g, F.col("source_id") == F.col("_s"), "left").select("source_id", F.coalesce("digest", F.lit(NO_NOTES)).alias("digest"))


def section_order(blocks: DataFrame, stage: str, key: str = "doc_id", wanted: list[str] | None = None) -> DataFrame:
    """blocks (from sections()) with place: the order of round-robin turns over sections by priority.

    In the extract stage, captioned blocks come first within their section, and the sections in
    ``wanted`` come before all others.
    """
    path = F.col("section_path")
    if stage == "classify":
        priority = F.when(path.rlike(FIRST[stage]), 0).when(path.rlike("(?i)introduction|conclu"), 1).otherwise(2)
        within = [F.col("idx")]
    else:
        priority = F.when(F.col("section_id").isin(wanted or [""]), 0).when(path.rlike(FIRST[stage]), 1).otherwise(2)
        within = [F.when(F.col("candidate_label").isNotNull(), 0).otherwise(1), F.col("idx")]
    turn = F.row_number().over(Window.partitionBy(key, "section_no").orderBy(*within))
    b = blocks.select("*", turn.alias("turn"))
    # a section's blocks have one path, which can be as long as its headings: it is matched once
    b = b.withColumn("priority", F.max(F.when(F.col("turn") == 1, priority)).over(Window.partitionBy(key, "section_no")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn", "priority", "section_no"))
    return b.withColumn("place", place.cast("long"))


_JSON = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical(value) -> str:
    """Sorted keys, no blanks, all characters as they are; NaN is refused."""
    return _JSON.encode(value)


def packed(ordered: DataFrame, budget: int, start: int = 0, key: str = "doc_id", cost: str = "cost") -> DataFrame:
    """key, place, kept: a block is skipped if it overflows, and later ones that fit are still taken.

    A fold over the ordered costs of one document, in built-in functions; a document's blocks are
    one array.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", F.col(cost).cast("long").alias("c"))))
    empty = F.array().cast("array<struct<place:long,kept:boolean>>")

    def step(a, x):
        fits = a["used"] + x["c"] <= budget
        return F.struct(F.when(fits, a["used"] + x["c"]).otherwise(a["used"]).alias("used"), F.concat(a["kept"], F.array(F.struct(x["place"].alias("place"), fits.alias("kept")))).alias("kept"))

    g = ordered.groupBy(key).agg(rows.alias("rows"))
    fold = F.aggregate("rows", F.struct(F.lit(start).cast("long").alias("used"), empty.alias("kept")), step, lambda a: a["kept"])
    return g.select(key, F.explode(fold).alias("x")).select(key, "x.place", "x.kept")


def bounded_metadata(metadata: dict) -> tuple[dict, bool]:
    """Title and authors cut until the canonical form has 3,000 characters at most; whether that took more than plain limits."""
    m = {**metadata, "title": str(metadata.get("title") or "")[:1000], "authors": [str(a)[:200] for a in (metadata.get("authors") or [])[:32]]}
    whole = len(canonical(m)) <= 3000
    while len(canonical(m)) > 3000 and (m["authors"] or m["title"]):
        if m["authors"]:
            m["authors"].pop()
        else:
            m["title"] = m["title"][: len(m["title"]) // 2]
    return m, not whole


def _sizes(blocks: list, stage: str, metadata: str) -> list[tuple]:
    """place, kept, cost, truncated, abstract, omitted_sections, metadata_truncated of one document's blocks, in the order of place."""
    budget = BUDGETS[stage]
    firsts: dict = {}
    for r in sorted(blocks, key=lambda r: r["reference_id"]):
        firsts.setdefault(r["section_no"], r)
    heads = sorted(firsts.values(), key=lambda r: (r["priority"], r["section_no"]))[:160]
    stated = json.loads(blocks[0]["metadata"] or metadata)
    stated, cut = bounded_metadata(stated) if stated else (stated, False)
    frame = {"stage": stage, "metadata": stated, "section_hierarchy": [], "abstract_candidates": [], "blocks": [], "coverage": {}}
    # what the frame takes with each section more: its own form, and a comma from the second on
    size = len(canonical(frame))
    ends = [size]
    for r in heads:
        size += len(canonical({"id": r["section_id"], "heading_path": r["section_path"][:300], "level": r["level"], "parent_path": r["parent_path"][:300]})) + (len(ends) > 1)
        ends.append(size)
    sent = next((n for n in range(len(heads), 0, -1) if ends[n] <= budget // 3), 0)
    size, most, rows = ends[sent] + 600, budget - RESERVED[stage], []
    for r in blocks:
        box, text, path = r["bbox"], r["text"] or "", r["section_path"][:300]
        if box:
            box = {k: v for k, v in json.loads(box).items() if k != "spans"}
        long = len(text) > MOST_TEXT
        item = {"reference_id": r["reference_id"], "block_id": r["block_id"], "page": r["page"], "heading_path": path, "kind": r["kind"], "role": r["role"], "bbox": box or None, "text": text[:MOST_TEXT], "text_truncated": long, "candidate_label": r["candidate_label"], "section_id": r["section_id"]}
        cost = len(canonical(item)) + 1
        fits = size + cost <= most
        size += cost if fits else 0
        rows.append((r["place"], fits, cost, long, "abstract" in path.lower()))
    kept = [x for x in rows if x[1]]
    chosen = [x[0] for x in kept if x[4]][:8] or [x[0] for x in kept[:3]]
    return [(*x[:4], x[0] in chosen, len(firsts) - sent, cut) for x in rows]


def select_context(ordered: DataFrame, stage: str, key: str = "doc_id", metadata: str = "{}") -> DataFrame:
    """section_order()'s blocks under the stage's budget of canonical JSON.

    key, place, kept, cost; truncated: whether the text was cut; abstract: whether the block is a
    candidate for the abstract (kept blocks below a heading that says so, eight at most, else the first
    three kept); omitted_sections and metadata_truncated of the document. Optional columns: page,
    role, level, bbox (JSON; its spans are left out) and metadata (JSON, one a document, in place of
    the argument), as positioned documents have them; null ones count as missing.

    A window lays a document's blocks together in their order, and the documents pass by one after the other: at any time
    one document is held, and none is a group of its own between Spark and Python.
    """
    kind = ordered.schema[key].dataType.simpleString()

    def pick(batches):
        import pyarrow as pa

        type_, held, out, ids = None, [], [], []

        def batch():
            columns = [pa.array(ids, type_), *[pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()])]]
            return pa.RecordBatch.from_arrays(columns, [key, "place", "kept", "cost", "truncated", "abstract", "omitted_sections", "metadata_truncated"])

        def close():
            ids.extend([held[0][key]] * len(held))
            out.extend(_sizes(held, stage, metadata))
            held.clear()

        for b in batches:
            type_ = b.schema.field(key).type
            for r in b.to_pylist():
                if held and held[0][key] != r[key]:
                    close()
                    if len(out) >= 20_000:
                        yield batch()
                        out.clear(), ids.clear()
                held.append(r)
        if held:
            close()
        if out:
            yield batch()

    more = {"page": "int", "role": "string", "level": "int", "bbox": "string", "metadata": "string"}
    extra = [(F.col(c) if c in ordered.columns else F.lit(None)).cast(t).alias(c) for c, t in more.items()]
    cols = [key, "place", "priority", "section_no", "section_id", F.left("section_path", F.lit(300)).alias("section_path"), F.left("parent_path", F.lit(300)).alias("parent_path"), "reference_id", "block_id", "kind", F.left("text", F.lit(MOST_TEXT + 1)).alias("text"), "candidate_label"]
    rows = ordered.select(*cols, *extra).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("place")))
    return rows.mapInArrow(pick, f"{key} {kind}, place long, kept boolean, cost long, truncated boolean, abstract boolean, omitted_sections long, metadata_truncated boolean")


def coverage(selected: DataFrame, stage: str = "extract", key: str = "doc_id") -> DataFrame:
    """key, total_blocks, sent_blocks, omitted_blocks, truncated_blocks, omitted_sections, character_budget, metadata_truncated."""
    return selected.groupBy(key).agg(
        F.count("*").alias("total_blocks"),
        F.count_if("kept").alias("sent_blocks"),
        F.count_if(~F.col("kept")).alias("omitted_blocks"),
        F.count_if(F.col("kept") & F.col("truncated")).alias("truncated_blocks"),
        F.max("omitted_sections").alias("omitted_sections"),
        F.lit(BUDGETS[stage]).cast("long").alias("character_budget"),
        F.max("metadata_truncated").alias("metadata_truncated"),
    )
