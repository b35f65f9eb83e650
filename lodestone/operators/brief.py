"""Structured, evidence-backed summaries: statuses, merges under user protection, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RESOLUTIONS

FIELD = ["value_json", "status", "evidence_json", "origin", "user_edited", "provenance_json"]
# The fields of the quick view, and those that follow for each type of paper.
QUICK = ["one_line_summary", "research_objective", "background", "problem", "target_task", "novelty", "key_results"]
BY_TYPE = {
    "survey": ["paper_type", "target_domain", "model_family", "limitations", "suggested_reading_order"],
    "benchmark": ["paper_type", "datasets", "evaluation_settings", "metrics", "baselines", "limitations"],
    "dataset": ["paper_type", "datasets", "evaluation_settings", "metrics", "baselines", "limitations"],
    "": ["paper_type", "model_family", "base_model", "learning_regimes", "shots", "adaptation_methods", "datasets", "metrics"],
}


def protected() -> Column:
    """A field that automatic writes leave alone."""
    return (F.col("origin") == "user") | F.col("user_edited")


def effective_status(fields: DataFrame, resolutions: DataFrame) -> DataFrame:
    """fields with effective: confirmed stays only with references that all are resolved.

    fields: source_id, field_name, status, refs (array). resolutions: source_id, evidence_id, status.
    """
    e = fields.select("source_id", "field_name", F.explode("refs").alias("evidence_id"))
    r = resolutions.select(F.col("source_id").alias("_s"), F.col("evidence_id").alias("_e"), F.col("status").alias("found"))
    j = e.join(r, (F.col("source_id") == F.col("_s")) & (F.col("evidence_id") == F.col("_e")), "left")
    bad = j.groupBy(F.col("source_id").alias("_fs"), F.col("field_name").alias("_fn")).agg(F.count_if(F.coalesce(F.col("found"), F.lit("")) != "resolved").alias("open"))
    k = fields.join(bad, (F.col("source_id") == F.col("_fs")) & (F.col("field_name") == F.col("_fn")), "left")
    sure = (F.size("refs") > 0) & (F.coalesce("open", F.lit(0)) == 0)
    return k.withColumn("effective", F.when((F.col("status") == "confirmed") & ~sure, "uncertain").otherwise(F.col("status"))).drop("_fs", "_fn", "open")


def result_downgrade(status: Column, results: Column) -> Column:
    """A confirmed list of results with an uncertain one among them is uncertain."""
    return F.when((status == "confirmed") & F.coalesce(F.exists(results, lambda r: r["status"] == "uncertain"), F.lit(False)), "uncertain").otherwise(status)


def nested_refs(values: Column) -> Column:
    """The references inside a list of results, figures or tables, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: v["evidence"])))


def evidence_counts(resolved: DataFrame, by: list[str]) -> DataFrame:
    """by, and a count for each of the four statuses."""
    return resolved.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in RESOLUTIONS])


def _joined(current: DataFrame, incoming: DataFrame, how: str) -> DataFrame:
    c = current.select(F.col("source_id").alias("c_source"), F.col("field_name").alias("c_field"), *[F.col(f).alias(f"c_{f}") for f in FIELD])
    return incoming.join(c, (F.col("source_id") == F.col("c_source")) & (F.col("field_name") == F.col("c_field")), how)


def merged(current: DataFrame, incoming: DataFrame, automatic: bool = True) -> DataFrame:
    """Brief fields after a write, with written; automatic writes leave protected fields as they are.

    Both: source_id, field_name and FIELD; one row a source and field. Written fields are unverified.
    """
    j = _joined(current, incoming, "full")
    guarded = F.col("c_field").isNotNull() & ((F.col("c_origin") == "user") | F.col("c_user_edited"))
    write = F.col("field_name").isNotNull() & (~guarded if automatic else F.lit(True))
    write = F.coalesce(write, F.lit(False))
    pick = lambda f: F.when(write, F.col(f)).otherwise(F.col(f"c_{f}")).alias(f)
    return j.select(F.coalesce("source_id", "c_source").alias("source_id"), F.coalesce("field_name", "c_field").alias("field_name"), *[pick(f) for f in FIELD], write.alias("written"))


def revisions(briefs: DataFrame, written: DataFrame) -> DataFrame:
    """source_id, revision after a write: one more for known sources, 1 for new ones."""
    w = written.select(F.col("source_id").alias("_w")).distinct()
    j = briefs.join(w, F.col("source_id") == F.col("_w"), "full")
    revision = F.when(F.col("source_id").isNull(), 1).when(F.col("_w").isNotNull(), F.col("revision") + 1).otherwise(F.col("revision"))
    return j.select(F.coalesce("source_id", "_w").alias("source_id"), revision.cast("int").alias("revision"))


def import_actions(current: DataFrame, incoming: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """source_id, field_name, action, conflict: what an import would do with each incoming field."""
    j = _joined(current, incoming, "left")
    known = F.col("c_field").isNotNull()
    guarded = known & ((F.col("c_origin") == "user") | F.col("c_user_edited"))
    action = F.when(F.col("field_name").isin(list(excluded) or [""]), "excluded").when(guarded, "preserve_user").when(known, "update").otherwise("add")
    conflict = F.when(known & F.col("c_user_edited"), "user_edited").when(known & (F.col("c_origin") == "user"), "user_origin").when(known, "existing_field")
    return j.select("source_id", "field_name", action.alias("action"), conflict.alias("conflict"))


def regeneration_actions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """source_id, field_name, action: preserve_user, new_field, unchanged or generated_update."""
    j = _joined(current, incoming, "left")
    known = F.col("c_field").isNotNull()
    guarded = known & ((F.col("c_origin") == "user") | F.col("c_user_edited"))
    same = F.lit(True)
    for f in ("value_json", "status", "evidence_json", "origin", "user_edited"):
        same = same & F.col(f).eqNullSafe(F.col(f"c_{f}"))
    action = F.when(guarded, "preserve_user").when(~known, "new_field").when(same, "unchanged").otherwise("generated_update")
    return j.select("source_id", "field_name", action.alias("action"))


def import_preview(actions: DataFrame, counts: DataFrame, targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """source_id, can_commit, review_reasons (in their order), selected.

    actions: import_actions(). counts: evidence_counts by source_id. targets: source_id, matched,
    manual, warnings. ledger: source_id of packages imported before.
    """
    a = actions.groupBy(F.col("source_id").alias("_a")).agg(F.count_if(F.col("action").isin("add", "update")).alias("selected"), F.count("conflict").alias("conflicts"))
    led = ledger.select(F.col("source_id").alias("_l")).distinct()
    c = counts.withColumnRenamed("source_id", "_c")
    j = targets.join(a, F.col("source_id") == F.col("_a"), "left").join(c, F.col("source_id") == F.col("_c"), "left").join(led, F.col("source_id") == F.col("_l"), "left")
    n = lambda x: F.coalesce(x, F.lit(0))
    again = F.col("_l").isNotNull()
    reasons = [
        (~F.col("matched"), "manual_source_selection_required"),
        ((n("candidates") + n("unresolved") + n("page_only") + n("warnings")) > 0, "evidence_needs_review"),
        (n("conflicts") > 0, "field_conflicts"),
        (again, "duplicate_import"),
        (n("selected") == 0, "no_writable_fields"),
        (F.col("manual"), "manual_source_selection"),
    ]
    listed = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]), lambda x: x.isNotNull())
    return j.select("source_id", (F.col("matched") & ~again & (n("selected") > 0)).alias("can_commit"), F.array_join(listed, ",").alias("review_reasons"), n("selected").cast("long").alias("selected"))


def snapshot_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, digest of its rows in a fixed order: a commit goes ahead only if it is what the preview saw."""
    packed = F.to_json(F.struct(*columns))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(packed)), "\n"), 256).alias("digest"))


def quick_view(fields: DataFrame) -> DataFrame:
    """The fields that a quick view shows: source_id, ord, field_name, value_json, status (null: missing).

    Seven fields, then those of the source's paper_type (as JSON text in value_json).
    """
    names = lambda xs: F.array(*map(F.lit, xs))
    kind = F.max(F.when(F.col("field_name") == "paper_type", F.trim(F.col("value_json"), F.lit('"'))))
    ids = fields.groupBy(F.col("source_id").alias("sid")).agg(kind.alias("kind"))
    more = names(BY_TYPE[""])
    for k, xs in BY_TYPE.items():
        if k:
            more = F.when(F.col("kind") == k, names(xs)).otherwise(more)
    rows = ids.select("sid", F.posexplode(F.concat(names(QUICK), more)).alias("ord", "name"))
    j = rows.join(fields, (F.col("sid") == F.col("source_id")) & (F.col("name") == F.col("field_name")), "left")
    return j.select(F.col("sid").alias("source_id"), "ord", F.col("name").alias("field_name"), "value_json", "status")
