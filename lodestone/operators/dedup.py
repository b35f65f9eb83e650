"""Duplicate sources and bibliographic identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import arxiv_key, doi_key, title_key


def duplicate_keys(sources: DataFrame) -> DataFrame:
    """id, key_type, key: what makes a source equal to another; address and canonical address meet."""
    keys = [("content_hash", "content_hash"), ("doi", "doi"), ("arxiv_id", "arxiv_id"), ("url", "url"), ("url", "canonical_url")]
    arr = F.array(*[F.struct(F.lit(t).alias("key_type"), F.col(c).alias("key")) for t, c in keys])
    return sources.select("id", F.explode(arr).alias("x")).select("id", "x.key_type", "x.key").filter("key <> ''").distinct()


def duplicate_groups(sources: DataFrame) -> DataFrame:
    """key_type, key, first_id, n of every key that several sources share. Keyed, never a cross product."""
    g = duplicate_keys(sources).groupBy("key_type", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return g.filter("n > 1")


def find_duplicates(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """id (incoming), existing_id: sources that share any key with an incoming one."""
    old = duplicate_keys(sources).withColumnRenamed("id", "existing_id")
    return duplicate_keys(incoming).join(old, ["key_type", "key"]).select("id", "existing_id").distinct()


def identity_match(identities: DataFrame, sources: DataFrame, key=title_key) -> DataFrame:
    """identity_id, status, method, strength, n_candidates, contradictions, source_id, manual.

    Five keyed joins, tagged by their order; of each identity only the first method with hits counts.
    identities: identity_id, title, authors (array), year, doi, arxiv_id, source_hash. sources: id,
    title, authors, year, doi, arxiv_id, content_hash. ``key`` compares titles and authors.
    """
    def prepared(df: DataFrame, ident: str, hash_: str) -> DataFrame:
        names = df.select(F.col(ident).alias("i"), F.explode_outer("authors").alias("a")).select("i", key(F.col("a")).alias("a"))
        names = names.groupBy(F.col("i").alias("_i")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.col("a")))), "\x1f").alias("names"), F.count("a").alias("n_names"))
        p = df.select(F.col(ident).alias("i"), key(F.col("title")).alias("tk"), "year", doi_key(F.col("doi")).alias("dk"), arxiv_key(F.col("arxiv_id")).alias("ak"), F.lower(F.coalesce(hash_, F.lit(""))).alias("hk"))
        p = p.join(names, F.col("i") == F.col("_i"), "left").drop("_i")
        tay = F.when(F.col("year").isNotNull(), F.concat_ws("\x1e", "tk", F.col("year").cast("string"), "names"))
        return p.withColumn("ty", tay)

    own, theirs = prepared(identities, "identity_id", "source_hash"), prepared(sources, "id", "content_hash")
    own = own.withColumn("ty", F.when((F.size(F.split("names", "\x1f")) > 0) & (F.col("n_names") > 0), F.col("ty")))
    tags = [("hk", 1), ("dk", 2), ("ak", 3), ("ty", 4), ("tk", 5)]

    def keys(df: DataFrame) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(n).alias("p"), F.col(c).alias("k")) for c, n in tags])
        return df.select("i", "dk", "ak", F.explode(arr).alias("x")).select("i", "dk", "ak", "x.p", "x.k").filter("k IS NOT NULL AND (k <> '' OR p = 5)")

    # sources that agree in all that counts are one row, however many share a title
    b = keys(theirs).groupBy("p", "k", F.col("dk").alias("sdk"), F.col("ak").alias("sak")).agg(F.min("i").alias("sid"), F.count("*").alias("many"))
    hits = keys(own).join(b, ["p", "k"])
    clash = ((F.col("dk") != "") & (F.col("sdk") != "") & (F.col("dk") != F.col("sdk"))).cast("long") + ((F.col("ak") != "") & (F.col("sak") != "") & (F.col("ak") != F.col("sak"))).cast("long")
    per = hits.groupBy("i", "p").agg(F.sum("many").alias("n"), F.sum(clash * F.col("many")).alias("c"), F.min("sid").alias("sid"))
    first = per.groupBy("i").agg(F.min_by(F.struct("p", "n", "c", "sid"), "p").alias("m"))
    j = identities.select("identity_id").join(first, F.col("identity_id") == F.col("i"), "left")
    names = F.create_map(*[F.lit(x) for p in ((1, "content_hash"), (2, "doi"), (3, "arxiv_id"), (4, "title_authors_year"), (5, "title")) for x in p])
    strong = (F.col("m.p") <= 3) & (F.col("m.n") == 1) & (F.col("m.c") == 0)
    return j.select(
        "identity_id",
        F.when(F.col("m").isNull(), "unmatched").when(F.col("m.n") == 1, "matched").otherwise("ambiguous").alias("status"),
        names[F.col("m.p")].alias("method"),
        F.when(F.col("m.p") <= 3, "strong").when(F.col("m").isNotNull(), "weak").alias("strength"),
        F.coalesce("m.n", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("m.c", F.lit(0)).cast("long").alias("contradictions"),
        F.when(strong, F.col("m.sid")).alias("source_id"),
        (~F.coalesce(strong, F.lit(False))).alias("manual_selection_required"),
    )
