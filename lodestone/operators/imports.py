"""What an import of packages would do: identity, evidence, field statuses and actions, composed for many packages at once.

A package finds its source by identity, unless one was chosen for it; its evidence is resolved on that source's latest version, and
is unresolved where there is no source. Confirmed fields whose evidence isn't all resolved become uncertain, which is a warning.
Each part is a keyed join; nothing is decided package by package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key
from ..session import scratch
from .anchors import resolve_portable
from .blocks import latest_versions
from .brief import effective_status, evidence_counts, import_actions, import_preview
from .dedup import identity_match


@dataclass
class Preview:
    """packages: source_id (the target, null without one), method, can_commit, disposition, review_reasons, selected, warnings and
    the counts of evidence by package_id. fields: package_id, field_name, status, requested_status, action, conflict. evidence: package_id,
    evidence_id, status, method, reason."""

    packages: DataFrame
    fields: DataFrame
    evidence: DataFrame


def preview(packages: DataFrame, fields: DataFrame, evidence: DataFrame, sources: DataFrame, versions: DataFrame, blocks: DataFrame, current: DataFrame, ledger: DataFrame, excluded: list[str] = (), key=title_key) -> Preview:
    """packages: package_id, payload_hash, chosen (a source's id, or null), and title, authors, year, doi, arxiv_id, source_hash.

    fields: package_id, field_name, refs, and the columns of brief.FIELD. evidence: package_id, evidence_id, and what resolve_portable() reads
    but the version. current: the briefs that are there (brief.merged()'s). ledger: package_id, payload_hash of earlier imports.
    A chosen source that isn't there counts as none.
    """
    last = latest_versions(versions).select(F.col("id").alias("version_id"), F.col("source_id").alias("_v"), "content_hash")
    match = identity_match(packages.withColumnRenamed("package_id", "identity_id"), sources, key=key)
    match = match.select(F.col("identity_id").alias("_m"), F.col("source_id").alias("matched"), "method")
    t = packages.select("package_id", "payload_hash", "chosen", "source_hash").join(match, F.col("package_id") == F.col("_m")).drop("_m")
    t = t.withColumn("wanted", F.coalesce("chosen", "matched"))
    t = t.join(last, F.col("wanted") == F.col("_v"), "left").withColumn("source_id", F.col("_v")).drop("_v", "wanted", "content_hash")
    t = scratch(t, "import-targets")
    pair = F.concat_ws("\x1f", "package_id", "evidence_id").alias("anchor_id")
    e = evidence.select("*", pair).join(t.select(F.col("package_id").alias("_p"), "version_id", F.col("source_hash").alias("package_hash")), F.col("package_id") == F.col("_p")).drop("_p")
    used = t.filter("version_id IS NOT NULL").select(F.col("version_id").alias("_u")).distinct()
    here = blocks.join(used, F.col("version_id") == F.col("_u"), "left_semi")
    there = last.select(F.col("version_id").alias("id"), "content_hash").join(used, F.col("id") == F.col("_u"), "left_semi")
    found = resolve_portable(e.filter("version_id IS NOT NULL"), here, there, package_hash=F.col("package_hash"))
    found = found.select(F.col("anchor_id").alias("_a"), "status", "method", "reason")
    ev = e.select("package_id", "evidence_id", "anchor_id").join(found, F.col("anchor_id") == F.col("_a"), "left")
    ev = ev.select("package_id", "evidence_id", F.coalesce("status", F.lit("unresolved")).alias("status"), "method", F.when(F.col("_a").isNull(), "source_not_selected").otherwise(F.col("reason")).alias("reason"))
    ev = scratch(ev, "import-evidence")
    asked = fields.withColumnRenamed("package_id", "source_id")
    judged = effective_status(asked, ev.withColumnRenamed("package_id", "source_id")).withColumn("requested_status", F.col("status"))
    judged = scratch(judged.withColumn("status", F.col("effective")).drop("effective"), "import-fields")
    mine = t.select("package_id", F.col("source_id").alias("_s")).join(current.withColumnRenamed("source_id", "_c"), F.col("_s") == F.col("_c"))
    mine = mine.drop("_s", "_c").withColumnRenamed("package_id", "source_id")
    act = import_actions(mine, judged, list(excluded))
    warnings = judged.groupBy(F.col("source_id").alias("_w")).agg(F.count_if(F.col("status") != F.col("requested_status")).alias("warnings"))
    targets = t.select(F.col("package_id").alias("p"), F.col("source_id").isNotNull().alias("matched"), (F.col("chosen").isNotNull() & F.col("source_id").isNotNull()).alias("manual"))
    targets = targets.join(warnings, F.col("p") == F.col("_w"), "left").select(F.col("p").alias("source_id"), "matched", "manual", F.coalesce("warnings", F.lit(0)).alias("warnings"))
    done = ledger.select(F.col("package_id").alias("key")).unionByName(ledger.select(F.col("payload_hash").alias("key"))).distinct()
    again = t.select("package_id", F.explode(F.array("package_id", "payload_hash")).alias("key")).join(done, "key", "left_semi").select(F.col("package_id").alias("source_id")).distinct()
    counts = evidence_counts(ev.withColumnRenamed("package_id", "source_id"), ["source_id"])
    verdict = import_preview(act, counts, targets, again).withColumnRenamed("source_id", "_i")
    out = t.join(verdict, F.col("package_id") == F.col("_i")).join(counts.withColumnRenamed("source_id", "_n"), F.col("package_id") == F.col("_n"), "left")
    out = out.join(targets.select(F.col("source_id").alias("_t"), "warnings"), F.col("package_id") == F.col("_t"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    disposition = F.when(F.col("review_reasons") == "", "importable").otherwise("requires_review").alias("disposition")
    out = out.select("package_id", "source_id", "method", "can_commit", disposition, "review_reasons", "selected", n("warnings"), *[n(s) for s in ("resolved", "candidates", "page_only", "unresolved")])
    a = act.select(F.col("source_id").alias("_as"), F.col("field_name").alias("_af"), "action", "conflict")
    rows = judged.join(a, (F.col("source_id") == F.col("_as")) & (F.col("field_name") == F.col("_af")))
    return Preview(out, rows.select(F.col("source_id").alias("package_id"), "field_name", "status", "requested_status", "action", "conflict"), ev)
