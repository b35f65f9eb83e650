"""Checks of generated summaries, and the lifecycles of previews and jobs as tables.

Decisions are columns: a caller applies the rows that are allowed and reports the others' codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_ws
from .anchors import occurrences, resolve_portable
from .blocks import caption_label, latest_versions
from .brief import effective_status

#: Why an output is refused, the first that holds in this order.
REJECTIONS = ["invalid_evidence", "unknown_block_reference", "unknown_evidence", "duplicate_result", "structured_visual_reference_required", "block_quote_mismatch", "visual_caption_mismatch"]
PREVIEW_HOURS, JOB_MINUTES = 24, 20


def rejected(fields: DataFrame, evidence: DataFrame, context: DataFrame) -> DataFrame:
    """job_id, code of the outputs that are refused.

    fields: job_id, field_name, refs (array, nested ones included), result_ids (array), plain_items
    (whether a figure or table is no structure), labels (array of label, refs). evidence: job_id,
    evidence_id, block_ref, quote, prefix, suffix. context: job_id, reference_id, text (blocks sent).
    """
    sent = context.select(F.col("job_id").alias("_j"), F.col("reference_id").alias("_r"), "text")
    code = lambda df, n: df.select("job_id", F.lit(n).alias("n"))
    twice = evidence.groupBy("job_id", "evidence_id").count().filter("count > 1 OR evidence_id LIKE 'B%'")
    named = evidence.filter(F.coalesce("block_ref", F.lit("")) != "")
    unknown_block = named.join(sent, (F.col("job_id") == F.col("_j")) & (F.col("block_ref") == F.col("_r")), "left_anti")
    known = evidence.select(F.col("job_id").alias("_j"), F.col("evidence_id").alias("_r")).unionByName(sent.select("_j", "_r"))
    wanted = fields.select("job_id", F.explode("refs").alias("ref")).distinct()
    unknown = wanted.join(known, (F.col("job_id") == F.col("_j")) & (F.col("ref") == F.col("_r")), "left_anti")
    results = fields.filter(F.size("result_ids") != F.size(F.array_distinct("result_ids")))
    plain = fields.filter(F.col("plain_items"))
    # a reference that names a block must quote it: its own words, in its own surroundings
    used = named.join(wanted.select(F.col("job_id").alias("_w"), F.col("ref")), (F.col("job_id") == F.col("_w")) & (F.col("evidence_id") == F.col("ref")), "left_semi")
    q = used.join(sent, (F.col("job_id") == F.col("_j")) & (F.col("block_ref") == F.col("_r")))
    body, quote = norm_ws(F.col("text")), norm_ws(F.coalesce(F.nullif("quote", F.lit("")), F.col("text")))
    before, after = norm_ws(F.col("prefix")), norm_ws(F.col("suffix"))
    fits = F.contains(body, quote) & (((before == "") & (after == "")) | (occurrences(body, quote, before, after) > 0))
    misquoted = q.filter(~fits)
    ref_block = q.select(F.col("job_id").alias("_qj"), F.col("evidence_id").alias("_qe"), "text").unionByName(sent.select(F.col("_j").alias("_qj"), F.col("_r").alias("_qe"), "text"))
    label = fields.select("job_id", F.explode("labels").alias("x")).select("job_id", F.col("x.label").alias("label"), F.explode("x.refs").alias("ref"))
    j = label.join(ref_block, (F.col("job_id") == F.col("_qj")) & (F.col("ref") == F.col("_qe")))
    same = F.coalesce(F.lower(caption_label(F.col("text"))) == F.lower("label"), F.lit(False))
    captions = j.groupBy("job_id", "label").agg(F.max(same).alias("ok")).filter("NOT ok")
    every = code(twice, 0)
    for n, df in enumerate([unknown_block, unknown, results, plain, misquoted, captions], 1):
        every = every.unionByName(code(df, n))
    first = every.groupBy("job_id").agg(F.min("n").alias("n"))
    return first.select("job_id", F.element_at(F.array(*map(F.lit, REJECTIONS)), F.col("n") + 1).alias("code"))


def commit_decisions(previews: DataFrame, fresh: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """preview_id, decision: commit, or why not. Nothing is written for any but commit.

    previews: preview_id, package_id, payload_hash, digest, expires_at, committed_at (ISO texts in UTC).
    fresh: preview_id, fresh_digest, can_commit, as computed again now. ledger: package_id, payload_hash.
    """
    done = ledger.select(F.col("package_id").alias("key")).unionByName(ledger.select(F.col("payload_hash").alias("key"))).distinct()
    keyed = previews.select("preview_id", F.explode(F.array("package_id", "payload_hash")).alias("key"))
    again = keyed.join(done, "key", "left_semi").select(F.col("preview_id").alias("_d")).distinct()
    f = fresh.select(F.col("preview_id").alias("_f"), "fresh_digest", "can_commit")
    j = previews.join(f, F.col("preview_id") == F.col("_f"), "left").join(again, F.col("preview_id") == F.col("_d"), "left")
    decision = (
        F.when(F.col("committed_at").isNotNull(), "already_committed")
        .when(F.col("expires_at") <= now, "expired")
        .when(F.col("_d").isNotNull(), "duplicate_import")
        .when(~F.col("digest").eqNullSafe(F.col("fresh_digest")), "stale")
        .when(~F.coalesce("can_commit", F.lit(False)), "not_writable")
        .otherwise("commit")
    )
    return j.select("preview_id", decision.alias("decision"))


def recovered(jobs: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    """jobs after recovery: those still generating since before the cutoff have failed as interrupted."""
    stale = (F.col("state") == "generating") & (F.col("updated_at") < cutoff)
    new = {"state": F.lit("failed"), "error": F.lit("interrupted"), "updated_at": now}
    return jobs.select(*[F.when(stale, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def startable(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, allowed: of the requests for a source, the first starts, if no job of it is generating."""
    busy = jobs.filter("state = 'generating'").select(F.col("source_id").alias("_b")).distinct()
    first = requests.groupBy(F.col("source_id").alias("_s")).agg(F.min("job_id").alias("_first"))
    j = requests.join(busy, F.col("source_id") == F.col("_b"), "left").join(first, F.col("source_id") == F.col("_s"))
    return j.select("job_id", (F.col("_b").isNull() & (F.col("job_id") == F.col("_first"))).alias("allowed"))


def published(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """jobs whose work is done: preview if their source is as it was at the start, else failed.

    jobs: job_id, source_id, state, snapshot. snapshots: source_id, current.
    """
    s = snapshots.select(F.col("source_id").alias("_s"), "current")
    j = jobs.join(s, F.col("source_id") == F.col("_s"), "left")
    same = F.col("snapshot").eqNullSafe(F.col("current"))
    state = F.when(F.col("state") != "generating", F.col("state")).when(same, "preview").otherwise("failed")
    return j.select("job_id", state.alias("state"), F.when((F.col("state") == "generating") & ~same, "source_changed").alias("error"))


def user_edits(edits: DataFrame, known: DataFrame) -> DataFrame:
    """source_id, field_name, allowed: an edit may only name evidence that its field already has.

    edits: source_id, field_name, refs. known: source_id, field_name, evidence_id.
    """
    e = edits.select("source_id", "field_name", F.explode("refs").alias("ref"))
    k = known.select(F.col("source_id").alias("_s"), F.col("field_name").alias("_f"), F.col("evidence_id").alias("_e"))
    new = e.join(k, (F.col("source_id") == F.col("_s")) & (F.col("field_name") == F.col("_f")) & (F.col("ref") == F.col("_e")), "left_anti")
    new = new.select(F.col("source_id").alias("_ns"), F.col("field_name").alias("_nf")).distinct()
    j = edits.join(new, (F.col("source_id") == F.col("_ns")) & (F.col("field_name") == F.col("_nf")), "left")
    return j.select("source_id", "field_name", F.col("_ns").isNull().alias("allowed"))


def edited(edits: DataFrame, known: DataFrame, versions: DataFrame, blocks: DataFrame) -> DataFrame:
    """source_id, field_name, value_json, status, requested_status, refused of a user's edits, judged on the sources' latest versions.

    An edit may only name evidence that its field already has (else refused: unknown_evidence). That evidence is resolved anew:
    where it was found before proves nothing about another version. A confirmed field whose evidence isn't all found again is
    uncertain. edits: source_id, field_name, value_json, status, refs. known: source_id, field_name, evidence_id and what resolve_portable()
    reads but the version. versions: id, source_id, fetched_at, seq, content_hash. A source without a version finds nothing.
    """
    allowed = user_edits(edits, known).select(F.col("source_id").alias("_s"), F.col("field_name").alias("_f"), "allowed")
    e = edits.join(allowed, (F.col("source_id") == F.col("_s")) & (F.col("field_name") == F.col("_f"))).drop("_s", "_f")
    field = F.concat_ws("\x1f", "source_id", "field_name").alias("field")
    e = e.select("*", field)
    wanted = e.filter("allowed").select(F.col("field").alias("_w"), F.explode("refs").alias("_r")).distinct()
    k = known.select("*", field).join(wanted, (F.col("field") == F.col("_w")) & (F.col("evidence_id") == F.col("_r")), "left_semi")
    last = latest_versions(versions).select(F.col("id").alias("version_id"), F.col("source_id").alias("_v"), "content_hash")
    k = k.join(last.select("version_id", "_v"), F.col("source_id") == F.col("_v"))
    k = k.withColumn("anchor_id", F.concat_ws("\x1f", "field", "evidence_id"))
    here = blocks.join(last.select(F.col("version_id").alias("_l")), F.col("version_id") == F.col("_l"), "left_semi")
    found = resolve_portable(k, here, last.select(F.col("version_id").alias("id"), "content_hash"))
    ids = k.select(F.col("anchor_id").alias("_a"), "field", "evidence_id")
    found = found.join(ids, F.col("anchor_id") == F.col("_a")).select(F.col("field").alias("source_id"), "evidence_id", "status")
    judged = effective_status(e.filter("allowed").select(F.col("field").alias("source_id"), "field_name", "status", "refs"), found).select(F.col("source_id").alias("_j"), "effective")
    out = e.join(judged, F.col("field") == F.col("_j"), "left")
    return out.select("source_id", "field_name", "value_json", F.col("effective").alias("status"), F.col("status").alias("requested_status"), F.when(~F.col("allowed"), "unknown_evidence").alias("refused"))
