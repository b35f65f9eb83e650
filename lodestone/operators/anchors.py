"""Evidence anchors: portable references resolved to exact blocks, never guessing between equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlap, parse, same_rect
from ..functions.text import norm_ws


def occurrences(text: Column, quote: Column, prefix: Column, suffix: Column) -> Column:
    """Overlapping places of a quote in a text (both normalised) with the given text before and after."""
    room = F.length(text) - F.length(quote) + 1
    places = F.when((quote != "") & F.contains(text, quote), F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>"))

    def fits(i):
        before = F.rtrim(F.substring(text, F.lit(1), i - 1))
        after = F.ltrim(F.substring(text, i + F.length(quote), F.length(text)))
        return (F.substring(text, i, F.length(quote)) == quote) & F.endswith(before, prefix) & F.startswith(after, suffix)

    return F.size(F.filter(places, fits)).cast("long")


def plain_count(text: Column, quote: Column) -> Column:
    """Places that don't overlap, as str.count counts."""
    n = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    return F.when(quote == "", F.lit(0)).otherwise((n / F.length(quote)).cast("long"))


_ANCHOR = {"quote": "string", "prefix": "string", "suffix": "string", "page": "int", "bbox": "string", "source_version": "string", "source_hash": "string", "block_id": "string", "block_idx": "long"}


def _prepared(anchors: DataFrame) -> DataFrame:
    cols = [F.col(c).cast(t).alias(c) if c in anchors.columns else F.lit(None).cast(t).alias(c) for c, t in _ANCHOR.items()]
    a = anchors.select("anchor_id", "version_id", *cols)
    return a.select("anchor_id", F.col("version_id").alias("_v"), *[norm_ws(F.col(c)).alias(c) for c in ("quote", "prefix", "suffix")], "page", parse(F.col("bbox")).alias("box"), "source_version", F.lower(F.coalesce("source_hash", F.lit(""))).alias("source_hash"), "block_id", "block_idx")


def _grams(text: Column) -> Column:
    """The distinct words of a normalised text and its runs of three words."""
    w = F.split(text, " ")
    n = F.greatest(F.size(w) - 2, F.lit(0))
    pair = lambda x, y: F.concat(x, F.lit(" "), y)
    threes = F.zip_with(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), pair), F.slice(w, 3, n), pair)
    return F.array_distinct(F.concat(w, threes))


def _key(quote: Column) -> Column:
    """What a block that holds the quote has among its _grams; null for quotes of one or two words.

    The first and last word of a quote may be parts of words, those between are whole.
    """
    w = F.split(quote, " ")
    longest = F.array_max(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return F.when(F.size(w) >= 5, F.array_join(F.slice(w, 2, 3), " ")).when(F.size(w) >= 3, longest)


#: Versions with more anchors than this find their blocks by keys.
FEW = 64


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Anchors beside the blocks of their version that hold their quote, are on their page, or are the block they name.

    Each pair comes once. has: the block holds the quote (or there is none); on_page: it is on the anchor's page. Where a
    version has FEW anchors at most, each of its blocks meets them in one join by version, and is dealt out once. Only
    versions with more (a broadcast of their ids, at most one for FEW anchors) have their blocks' words dealt out as keys;
    whether there are any is counted first, as a plan with both ways would deal out the blocks for each of them.
    """
    many = F.broadcast(a.groupBy(F.col("_v").alias("_m")).agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW).select("_m"))
    some = not many.isEmpty()
    quoted = F.col("quote") != ""
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    on_page, holds = F.coalesce((F.col("page") > 0) & (F.col("bpage") == F.col("page")), F.lit(False)), F.contains("btext", "quote")
    keep = F.when(quoted, holds | on_page).otherwise(on_page | same("bid", "block_id") | same("bidx", "block_idx"))
    rest = a.join(many, F.col("_v") == F.col("_m"), "left_anti") if some else a
    few = b.join(rest, F.col("_v") == F.col("bv")).filter(keep)
    few = few.select(*b.columns, *a.columns, (~quoted | holds).alias("has"), on_page.alias("on_page"))
    if not some:
        return few
    return few.unionByName(_met_by_keys(a.join(many, F.col("_v") == F.col("_m"), "left_semi"), b.join(many, F.col("bv") == F.col("_m"), "left_semi")))


def _met_by_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """_met() for versions with many anchors.

    A quote of three words or more meets the blocks that share its key, shorter ones
    all blocks of the version; pages, block ids and indexes are keys of their own.
    """
    quoted, here = F.col("quote") != "", F.col("_v") == F.col("bv")
    on_page = F.coalesce((F.col("page") > 0) & (F.col("bpage") == F.col("page")), F.lit(False))
    holds = F.contains("btext", "quote")
    keyed = a.withColumn("_key", _key(F.col("quote")))
    grams = b.select(F.col("bv").alias("gv"), F.col("bid").alias("gid"), F.explode(_grams(F.col("btext"))).alias("gram"))
    found = grams.join(keyed.filter(quoted & F.col("_key").isNotNull()), (F.col("_v") == F.col("gv")) & (F.col("_key") == F.col("gram")))
    found = found.join(b, (F.col("gv") == F.col("bv")) & (F.col("gid") == F.col("bid"))).filter(holds)
    short = b.join(keyed.filter(quoted & F.col("_key").isNull()), here).filter(holds)
    beside = b.join(a, here & (F.col("bpage") == F.col("page"))).filter(on_page & (~quoted | ~holds))
    named = b.join(a, here & (F.col("bid") == F.col("block_id"))).filter(~quoted & ~on_page)
    placed = b.join(a, here & (F.col("bidx") == F.col("block_idx"))).filter(~quoted & ~on_page & ~F.coalesce(F.col("bid") == F.col("block_id"), F.lit(False)))
    cols = [*b.columns, *a.columns]
    parts = [found.select(*cols, F.lit(True).alias("has")), short.select(*cols, F.lit(True).alias("has"))]
    parts += [beside.select(*cols, (~quoted).alias("has")), named.select(*cols, F.lit(True).alias("has")), placed.select(*cols, F.lit(True).alias("has"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("on_page", on_page)


def resolve(anchors: DataFrame, blocks: DataFrame, versions: DataFrame) -> DataFrame:
    """anchor_id, status, method, reason, block, candidates, page. Exact.

    Each anchor meets the blocks that it can be in (keyed joins), which yields features; one aggregate
    an anchor and one chain of cases decide, in the fixed order: block id, box, quote, ambiguous quote,
    changed context, ambiguous box, block index, page, nothing. anchors: anchor_id, version_id (to
    resolve on), and what they have of quote, prefix, suffix, page, bbox, source_version,
    source_hash, block_id, block_idx. blocks: version_id, id, idx, text, page, bbox_json.
    versions: id, content_hash.
    """
    v = versions.select(F.col("id").alias("vid"), F.lower(F.coalesce("content_hash", F.lit(""))).alias("vhash"))
    a = _prepared(anchors).join(v, F.col("_v") == F.col("vid"), "left")
    same_version = F.coalesce((F.col("source_version") != "") & (F.col("source_version") == F.col("vid")), F.lit(False))
    same_hash = F.coalesce((F.col("source_hash") != "") & (F.col("source_hash") == F.col("vhash")), F.lit(False))
    a = a.select("*", same_version.alias("same_version"), same_hash.alias("same_hash"))
    have = blocks.columns
    b = blocks.select(F.col("version_id").alias("bv"), F.col("id").alias("bid"), F.col("idx").alias("bidx"), norm_ws(F.col("text")).alias("btext"), (F.col("page") if "page" in have else F.lit(None).cast("int")).alias("bpage"), parse(F.col("bbox_json") if "bbox_json" in have else F.lit(None).cast("string")).alias("bbox"))
    j = _met(a, b)
    no_quote = F.col("quote") == ""
    box, own = F.col("box"), F.col("bbox")
    hit = F.col("on_page") & box.isNotNull() & own.isNotNull() & same_rect(own["page_rect"], box["page_rect"]) & F.coalesce(overlap(own["rect"], box["rect"]) >= 0.8, F.lit(False))
    n = F.when(F.col("has"), F.coalesce(occurrences(F.col("btext"), F.col("quote"), F.col("prefix"), F.col("suffix")), F.lit(0))).otherwise(0)
    j = j.select("*", n.alias("n"), hit.alias("hit"))
    j = j.select(
        "*",
        (F.col("hit") & (no_quote | (F.col("n") == 1))).alias("sup"),
        (F.col("same_version") & F.coalesce(F.col("block_id") == F.col("bid"), F.lit(False)) & F.col("has")).alias("id_m"),
        (F.col("same_version") & F.coalesce(F.col("block_idx") == F.col("bidx"), F.lit(False)) & F.col("has")).alias("ix_m"),
    )
    ref = F.struct(F.col("bidx").alias("idx"), F.col("bid").alias("id"), F.col("bpage").alias("page"))
    one = lambda flag: F.min(F.when(flag, ref))
    ids = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, ref))), lambda x: x["id"])
    g = j.groupBy(F.col("anchor_id").alias("_g")).agg(
        F.sum("n").alias("total"),
        F.count_if("has").alias("n_has"),
        F.count_if("hit").alias("n_hit"),
        F.count_if("sup").alias("n_sup"),
        F.count_if("ix_m").alias("n_ix"),
        F.count_if("on_page").alias("n_page"),
        F.count_if("id_m").alias("n_id"),
        one(F.col("id_m")).alias("b_id"),
        one(F.col("sup")).alias("b_sup"),
        one(F.col("n") > 0).alias("b_n"),
        one(F.col("ix_m")).alias("b_ix"),
        ids(F.col("n") > 0).alias("c_n"),
        ids(F.col("has")).alias("c_has"),
        ids(F.col("sup")).alias("c_sup"),
        ids(F.col("hit")).alias("c_hit"),
    )
    g = a.select("anchor_id", "quote", "page", "same_version", "same_hash").join(g, F.col("anchor_id") == F.col("_g"), "left")
    quoted = F.col("quote") != ""
    none = F.array().cast("array<string>")
    empty = F.lit(None).cast("struct<idx:long,id:string,page:int>")

    def result(status, method, reason, block=empty, cands=none):
        return F.struct(F.lit(status).alias("status"), F.lit(method).cast("string").alias("method"), F.lit(reason).cast("string").alias("reason"), block.cast("struct<idx:long,id:string,page:int>").alias("block"), cands.alias("candidates"))

    r = (
        F.when(F.col("n_id") > 0, result("resolved", "block_id", None, F.col("b_id")))
        .when((F.col("n_sup") == 1) & (F.col("same_version") | F.col("same_hash") | (F.col("total") == 1)), result("resolved", "bbox", None, F.col("b_sup")))
        .when(quoted & (F.col("total") == 1), result("resolved", "quote", None, F.col("b_n")))
        .when(quoted & (F.col("total") > 1), result("candidates", None, "ambiguous_quote", cands=F.col("c_n")))
        .when(quoted & (F.col("n_has") > 0), result("candidates", None, "context_changed", cands=F.col("c_has")))
        .when(F.col("n_hit") > 0, result("candidates", None, "ambiguous_bbox", cands=F.when(F.col("n_sup") > 0, F.col("c_sup")).otherwise(F.col("c_hit"))))
        .when(F.col("n_ix") > 0, result("resolved", "block_idx", None, F.col("b_ix")))
        .when(F.col("n_page") > 0, result("page_only", "page", "evidence_unresolved"))
        .otherwise(result("unresolved", None, "no_match"))
    )
    out = g.select("anchor_id", r.alias("r"), F.col("page").alias("asked"))
    page = F.when(F.col("r.status") == "resolved", F.col("r.block.page")).when(F.col("r.status") == "page_only", F.col("asked"))
    return out.select("anchor_id", "r.status", "r.method", "r.reason", "r.block", "r.candidates", page.alias("page"))


def resolve_portable(evidence: DataFrame, blocks: DataFrame, versions: DataFrame, package_hash: Column | None = None) -> DataFrame:
    """Resolve evidence of another library: foreign ids are dropped; a label helps only without a quote.

    evidence: anchor_id, version_id, quote, prefix, suffix, page, bbox, source_hash, figure_label,
    table_label. Returns anchor_id, status, method, reason, block, candidates, page.
    """
    e = evidence.withColumn("source_hash", F.coalesce("source_hash", package_hash if package_hash is not None else F.lit(None).cast("string")))
    base = resolve(e.drop("block_id", "block_idx", "source_version"), blocks, versions)
    # one by one: where a column is null throughout, Spark leaves it out, and its join with the blocks
    labels = [e.select("anchor_id", "version_id", F.col(c).alias("label")).filter("label <> ''") for c in ("figure_label", "table_label")]
    labels = labels[0].unionByName(labels[1])
    labels = labels.join(e.filter(norm_ws(F.col("quote")) == "").select(F.col("anchor_id").alias("_a")), F.col("anchor_id") == F.col("_a"), "left_semi")
    # labels hold letters, digits, dots and spaces: the pattern quotes them whole
    pattern = F.concat(F.lit("(?i)^\\Q"), F.replace("label", F.lit(" "), F.lit("\\E\\s+\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    have = blocks.columns
    b = blocks.select(F.col("version_id").alias("bv"), F.col("id").alias("bid"), F.col("idx").alias("bidx"), (F.col("page") if "page" in have else F.lit(None).cast("int")).alias("bpage"), norm_ws(F.col("text")).alias("btext"))
    hits = labels.join(b, F.col("version_id") == F.col("bv")).filter(F.expr("btext rlike concat('(?i)^', '\\\\Q', replace(label, ' ', '\\\\E\\\\s+\\\\Q'), '\\\\E(?![A-Za-z0-9])')"))
    hits = hits.select("anchor_id", F.struct(F.col("bidx").cast("long").alias("idx"), F.col("bid").alias("id"), F.col("bpage").alias("page")).alias("b")).distinct()
    hits = hits.groupBy(F.col("anchor_id").alias("_h")).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    j = base.join(hits, F.col("anchor_id") == F.col("_h"), "left")
    use = F.col("_h").isNotNull() & (F.col("status") != "resolved")
    one = use & (F.size("bs") == 1)
    pick = lambda new, old: F.when(use, new).otherwise(F.col(old)).alias(old)
    return j.select(
        "anchor_id",
        pick(F.when(one, F.lit("resolved")).otherwise(F.lit("candidates")), "status"),
        pick(F.when(one, F.lit("label")), "method"),
        pick(F.when(~one, F.lit("ambiguous_label")), "reason"),
        pick(F.when(one, F.get("bs", F.lit(0))), "block"),
        pick(F.when(~one, F.transform("bs", lambda x: x["id"])).otherwise(F.array().cast("array<string>")), "candidates"),
        pick(F.when(one, F.get("bs", F.lit(0))["page"]), "page"),
    )


def context_index(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchor_id, idx: the block whose surroundings may be used, or null. Exact.

    On the same version only the named block counts; else a block that alone holds the quote, once,
    with the text before and after.
    """
    a = _prepared(anchors)
    b = blocks.select(F.col("version_id").alias("bv"), F.col("id").alias("bid"), F.col("idx").alias("bidx"), norm_ws(F.col("text")).alias("btext"))
    j = b.join(a, F.col("_v") == F.col("bv"))
    same = F.coalesce(F.col("source_version") == F.col("_v"), F.lit(False))
    named = F.coalesce(F.nullif("block_id", F.lit("")), F.lit("")) != ""
    target = same & F.coalesce(F.when(named, F.col("block_id") == F.col("bid")).otherwise(F.col("block_idx") == F.col("bidx")), F.lit(False))
    j = j.withColumn("holds", F.coalesce((F.col("quote") != "") & F.contains("btext", "quote"), F.lit(False)))
    j = j.select("*", target.alias("target")).filter("target OR holds")
    target, holds = F.col("target"), F.col("holds")
    fits = holds & (plain_count(F.col("btext"), F.col("quote")) == 1) & (occurrences(F.col("btext"), F.col("quote"), F.col("prefix"), F.col("suffix")) > 0)
    first = F.instr(F.col("btext"), F.col("quote"))
    before, after = F.rtrim(F.substring("btext", F.lit(1), first - 1)), F.ltrim(F.substring("btext", first + F.length("quote"), F.length("btext")))
    fits = fits & F.endswith(before, F.col("prefix")) & F.startswith(after, F.col("suffix"))
    g = j.withColumn("fits", fits)
    fits = F.col("fits")
    g = g.groupBy(F.col("anchor_id").alias("_g")).agg(
        F.min(F.when(target, F.struct("bidx", ((F.col("quote") == "") | holds).alias("ok")))).alias("t"),
        F.count_if(holds).alias("n"),
        F.min(F.when(fits, F.col("bidx"))).alias("f"),
    )
    idx = F.when(F.col("t").isNotNull(), F.when(F.col("t.ok"), F.col("t.bidx"))).when(F.col("n") == 1, F.col("f"))
    return a.select("anchor_id").join(g, F.col("anchor_id") == F.col("_g"), "left").select("anchor_id", idx.cast("long").alias("idx"))


def made(selections: DataFrame) -> DataFrame:
    """Anchors of selections within one block: block_id, text, start, end (from 0) -> quote, prefix, suffix."""
    quote = F.left(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), F.lit(500))
    begin = F.greatest(F.col("start") - 60, F.lit(0))
    return selections.select("block_id", quote.alias("quote"), F.substring("text", begin + 1, F.col("start") - begin).alias("prefix"), F.substring("text", F.col("end") + 1, F.lit(60)).alias("suffix"))


def applied_highlights(resolved: DataFrame, anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchor_id, block_id: highlights that are shown: resolved, and the raw quote stands once in the block."""
    r = resolved.filter("status = 'resolved'").select("anchor_id", F.col("block.id").alias("block_id"))
    j = r.join(anchors.select(F.col("anchor_id").alias("_a"), F.col("quote").alias("raw")), F.col("anchor_id") == F.col("_a"))
    j = j.join(blocks.select(F.col("id").alias("_b"), "text"), F.col("block_id") == F.col("_b"))
    return j.filter(plain_count(F.col("text"), F.coalesce("raw", F.lit(""))) == 1).select("anchor_id", "block_id")


def quote_spans(spans: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id, span_no: spans of a text layer that hold the first 80 characters of a quote (display only).

    spans: page_key, span_no, text. quotes: quote_id, page_key, quote.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page_key").orderBy("span_no")
    s = spans.withColumn("stop", F.sum(F.length("text")).over(w)).withColumn("begin", F.col("stop") - F.length("text"))
    whole = spans.groupBy(F.col("page_key").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("layer"))
    q = quotes.select("quote_id", F.col("page_key").alias("_q"), F.left("quote", F.lit(80)).alias("quote")).join(whole, F.col("_q") == F.col("_p"))
    q = q.select("quote_id", "_q", (F.instr(F.col("layer"), F.col("quote")) - 1).alias("at"), F.length("quote").alias("n")).filter("at >= 0 AND n > 0")
    return q.join(s, F.col("_q") == F.col("page_key")).filter("begin < at + n AND stop > at").select("quote_id", "span_no")
