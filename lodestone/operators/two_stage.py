"""Summaries generated in two stages, for many sources at once: classify, then extract, with at most two tries each.

A provider is a function from a table of requests (job_id, stage, attempt, context, instructions) to a table of
replies (job_id, reply, failed); how it asks a model is its own affair. Only the requests of the tries that are
needed reach it: second tries are a table of the jobs whose first reply was refused. A second try is fresh:
nothing of a refused reply goes back. Every try is a row with its code.

A reply is JSON: fields (name, value, status, evidence), evidence (evidence_id, block_ref, quote, prefix, suffix) and
section_ids. It may be refused as output_too_large, invalid_json, invalid_field, unknown_section, or with one of
generation.REJECTIONS. A job whose provider fails ends as runtime_failed, one without a good reply as invalid_output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BRIEF_STATUS
from ..session import scratch
from .generation import rejected

MOST_OUTPUT, TRIES = 1 << 20, 2
AGAIN = "\nAn earlier reply was not valid. Keep to the schema, its statuses and the ids of the given blocks, and answer with a JSON object of its own."
REPLY = "struct<fields:array<struct<name:string,value:string,status:string,evidence:array<string>>>,evidence:array<struct<evidence_id:string,block_ref:string,quote:string,prefix:string,suffix:string>>,section_ids:array<string>>"

Provider = Callable[[DataFrame], DataFrame]


def contexts(blocks: DataFrame) -> DataFrame:
    """job_id, context: the blocks that are sent, as canonical JSON. blocks: job_id, reference_id, section_id, kind, text."""
    rows = F.array_sort(F.collect_list(F.struct("reference_id", "section_id", "kind", "text")))
    return blocks.groupBy("job_id").agg(F.to_json(rows).alias("context"))


def checked(replies: DataFrame, blocks: DataFrame, names: list[str]) -> DataFrame:
    """replies (job_id, reply, failed) with r (the reply as a struct) and code: why it is refused, or null.

    blocks: the blocks that each job was sent: job_id, reference_id, section_id, text.
    """
    r = replies.withColumn("r", F.from_json("reply", REPLY, {"mode": "PERMISSIVE"}))
    fine = F.col("r").isNotNull() & F.col("r.fields").isNotNull()
    fields = F.coalesce("r.fields", F.array().cast("array<struct<name:string,value:string,status:string,evidence:array<string>>>"))
    known = F.forall(fields, lambda f: F.coalesce(f["name"].isin(names) & f["status"].isin(BRIEF_STATUS), F.lit(False))) & (F.size(fields) == F.size(F.array_distinct(F.transform(fields, lambda f: f["name"]))))
    sections = blocks.groupBy(F.col("job_id").alias("_j")).agg(F.collect_set("section_id").alias("_sections"))
    r = r.join(sections, F.col("job_id") == F.col("_j"), "left").drop("_j")
    strange = F.size(F.array_except(F.coalesce("r.section_ids", F.array().cast("array<string>")), F.coalesce("_sections", F.array().cast("array<string>")))) > 0
    code = (
        F.when(F.col("failed"), "runtime_failed")
        .when(F.length("reply") > MOST_OUTPUT, "output_too_large")
        .when(~fine, "invalid_json")
        .when(~known, "invalid_field")
        .when(strange, "unknown_section")
    )
    r = scratch(r.withColumn("code", code).drop("_sections"), "replies")
    good = r.filter("code IS NULL")
    f = good.select("job_id", F.explode("r.fields").alias("f"))
    f = f.select("job_id", F.col("f.name").alias("field_name"), F.coalesce("f.evidence", F.array().cast("array<string>")).alias("refs"), F.array().cast("array<string>").alias("result_ids"), F.lit(False).alias("plain_items"), F.array().cast("array<struct<label:string,refs:array<string>>>").alias("labels"))
    e = good.select("job_id", F.inline(F.coalesce("r.evidence", F.array().cast("array<struct<evidence_id:string,block_ref:string,quote:string,prefix:string,suffix:string>>"))))
    bad = rejected(f, e, blocks.select("job_id", "reference_id", "text")).select(F.col("job_id").alias("_b"), F.col("code").alias("_code"))
    return r.join(bad, F.col("job_id") == F.col("_b"), "left").withColumn("code", F.coalesce("code", "_code")).drop("_b", "_code")


def stage(name: str, blocks: DataFrame, provider: Provider, names: list[str], instructions: str = "") -> tuple[DataFrame, DataFrame]:
    """Two tables: job_id, r of the jobs with a good reply; job_id, stage, attempt, code of every try (a good one's code is null)."""
    asked, good, tries = scratch(contexts(blocks), "contexts"), None, None
    for attempt in range(1, TRIES + 1):
        requests = asked.select("job_id", F.lit(name).alias("stage"), F.lit(attempt).alias("attempt"), "context", F.lit(instructions).alias("instructions"))
        found = scratch(checked(provider(requests).select("job_id", "reply", F.coalesce("failed", F.lit(False)).alias("failed")), blocks, names), "checked")
        row = found.select("job_id", F.lit(name).alias("stage"), F.lit(attempt).alias("attempt"), "code")
        kept = found.filter("code IS NULL").select("job_id", "r")
        good, tries = (kept, row) if good is None else (good.unionByName(kept), tries.unionByName(row))
        again = found.filter("code IS NOT NULL AND code <> 'runtime_failed'").select(F.col("job_id").alias("_again"))
        asked = asked.join(again, F.col("job_id") == F.col("_again"), "left_semi")
        instructions += AGAIN
    return good, tries


def _fields(good: DataFrame, blocks: DataFrame) -> DataFrame:
    """job_id, field_name, value, status, refs, body: whether a reference is to a block other than a heading or the title.

    Accepted replies refer to blocks that were sent, and quote them, so that all their references are resolved; a field without one
    isn't confirmed.
    """
    f = good.select("job_id", F.explode("r.fields").alias("f")).select("job_id", F.col("f.name").alias("field_name"), F.col("f.value").alias("value"), F.col("f.status").alias("status"), F.coalesce("f.evidence", F.array().cast("array<string>")).alias("refs"))
    f = f.withColumn("status", F.when((F.col("status") == "confirmed") & (F.size("refs") == 0), "uncertain").otherwise(F.col("status")))
    e = good.select("job_id", F.inline("r.evidence")).select("job_id", "evidence_id", F.col("block_ref"))
    ids = e.unionByName(blocks.select("job_id", F.col("reference_id").alias("evidence_id"), F.col("reference_id").alias("block_ref")))
    body = blocks.filter("kind <> 'heading' AND trim(text) <> trim(title)").select(F.col("job_id").alias("_j"), F.col("reference_id").alias("_r"))
    held = ids.join(body, (F.col("job_id") == F.col("_j")) & (F.col("block_ref") == F.col("_r")), "left_semi").select(F.col("job_id").alias("_h"), "evidence_id")
    used = f.select("job_id", "field_name", F.explode("refs").alias("ref")).join(held, (F.col("job_id") == F.col("_h")) & (F.col("ref") == F.col("evidence_id")), "left_semi")
    used = used.select(F.col("job_id").alias("_u"), F.col("field_name").alias("_n")).distinct()
    return f.join(used, (F.col("job_id") == F.col("_u")) & (F.col("field_name") == F.col("_n")), "left").withColumn("body", F.col("_u").isNotNull()).drop("_u", "_n")


def generated(blocks: DataFrame, provider: Provider, names: list[str], first: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: job_id, field_name, value, status, refs of the jobs that came through; job_id, stage, attempt, code; job_id, outcome.

    blocks: job_id, title, place, reference_id, section_id, kind, text. The first stage sees a job's ``first``
    blocks and names the type of paper and the sections that the second stage is to see (none: all). A type that
    no block of the body speaks for is uncertain. The second stage can't change the type. Fields that neither names are not_reported.
    """
    blocks = scratch(blocks, "brief-blocks")
    opening = blocks.filter(F.col("place") < first)
    one, tries = stage("classify", opening, provider, names)
    one = scratch(one, "classified")
    kind = _fields(one, opening).filter("field_name = 'paper_type'")
    unsure = F.col("status").isin("confirmed", "derived") & ~F.col("body")
    kind = kind.withColumn("status", F.when(unsure, "uncertain").otherwise(F.col("status"))).drop("body")
    chosen = one.select(F.col("job_id").alias("_c"), F.coalesce("r.section_ids", F.array().cast("array<string>")).alias("_want"))
    rest = blocks.join(chosen, F.col("job_id") == F.col("_c")).filter((F.size("_want") == 0) | F.array_contains("_want", F.col("section_id"))).drop("_c", "_want")
    rest = scratch(rest, "brief-sections")
    two, more = stage("extract", rest, provider, names)
    two = scratch(two, "extracted")
    done = two.select(F.col("job_id").alias("_d"))
    fields = kind.join(done, F.col("job_id") == F.col("_d"), "left_semi").unionByName(_fields(two, rest).filter("field_name <> 'paper_type'").drop("body"))
    every = two.select("job_id", F.explode(F.array(*map(F.lit, names))).alias("field_name"))
    f = fields.select(F.col("job_id").alias("_f"), F.col("field_name").alias("_n"), "value", "status", "refs")
    out = every.join(f, (F.col("job_id") == F.col("_f")) & (F.col("field_name") == F.col("_n")), "left")
    out = out.select("job_id", "field_name", "value", F.coalesce("status", F.lit("not_reported")).alias("status"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    tries = scratch(tries.unionByName(more), "tries")
    last = tries.groupBy("job_id").agg(F.max_by(F.struct("stage", "code"), F.struct(F.col("stage") == "extract", "attempt")).alias("last"))
    outcome = F.when((F.col("last.stage") == "extract") & F.col("last.code").isNull(), "preview").when(F.col("last.code") == "runtime_failed", "runtime_failed").otherwise("invalid_output")
    return out, tries, last.select("job_id", outcome.alias("outcome"))
