"""Citations between sources by the identifiers in their texts: edges, co-citation of wanted sources, rank.

A source cites another if its text holds the other's DOI or arXiv number, in any spelling of the
address. What is counted by source is added up within tasks first; a source that everybody cites is one row
of each task's sums. The rank's rounds are written tables, those before the last removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arxiv_key, doi_key
from ..session import release, scratch

# How identifiers are written in texts.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:a-z0-9]+\b"
ARXIV = r"(?i)arxiv(?:\.org/(?:abs|pdf|html)/|:\s*)(\d{4}\.\d{4,5})(?:v\d+)?"


def edges(texts: DataFrame, known: DataFrame) -> DataFrame:
    """citing, cited: each pair once; none cites itself. texts: id, text. known: id, doi, arxiv_id (null or empty: none).

    An identifier of several sources cites all of them.
    """
    dois = F.transform(F.regexp_extract_all("text", F.lit(DOI), 0), lambda x: F.concat(F.lit("doi:"), doi_key(F.regexp_replace(x, r"[.,;)]+$", ""))))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(ARXIV), 1), lambda x: F.concat(F.lit("arxiv:"), x))
    found = texts.select(F.col("id").alias("citing"), F.explode(F.array_distinct(F.concat(dois, numbers))).alias("key"))
    keys = F.array(F.concat(F.lit("doi:"), doi_key(F.col("doi"))), F.concat(F.lit("arxiv:"), arxiv_key(F.col("arxiv_id"))))
    own = known.select(F.col("id").alias("cited"), F.explode(F.filter(keys, lambda k: ~k.isin("doi:", "arxiv:"))).alias("key"))
    return found.join(own, "key").filter(F.col("citing") != F.col("cited")).select("citing", "cited").distinct()


def cocited(links: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """id, rank, other, n: for each wanted id the ``most`` sources that are cited most often beside it; ties to the smaller id.

    Work grows with the wanted ids' citing sources and what these cite, not with pairs of all that is cited.
    """
    w = links.join(wanted.select(F.col("id").alias("cited")).distinct(), "cited").withColumnRenamed("cited", "id")
    pairs = w.join(links.withColumnRenamed("cited", "other"), "citing").filter(F.col("id") != F.col("other"))
    n = pairs.groupBy("id", "other").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "other")).cast("long")
    return n.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "rank", "other", "n")


def ranked(links: DataFrame, ids: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, n_citing, n_cited_by, rank: how likely a reader who follows citations, and now and then starts anew, is at each source.

    ids: every source once. A source that cites nothing leads everywhere. rank: to nine places.
    """
    out = links.groupBy(F.col("citing").alias("_o")).agg(F.count("*").alias("n_citing"))
    into = links.groupBy(F.col("cited").alias("_i")).agg(F.count("*").alias("n_cited_by"))
    nodes = ids.select("id").join(out, F.col("id") == F.col("_o"), "left").join(into, F.col("id") == F.col("_i"), "left")
    nodes = scratch(nodes.select("id", F.coalesce("n_citing", F.lit(0)).alias("n_citing"), F.coalesce("n_cited_by", F.lit(0)).alias("n_cited_by")), "rank-nodes")
    total = nodes.count()
    if not total:
        return nodes.withColumn("rank", F.lit(0.0))
    links = scratch(links, "rank-links")
    now = scratch(nodes.select("id", "n_citing", F.lit(1.0 / total).alias("r")), "rank")
    for _ in range(rounds):
        loose = now.filter("n_citing = 0").agg(F.sum("r")).first()[0] or 0.0  # one number
        given = links.join(now.filter("n_citing > 0"), F.col("citing") == F.col("id")).groupBy("cited").agg(F.sum(F.col("r") / F.col("n_citing")).alias("got"))
        r = (1 - damping) / total + damping * (F.coalesce("got", F.lit(0.0)) + loose / total)
        after = scratch(now.drop("r").join(given, F.col("id") == F.col("cited"), "left").select("id", "n_citing", r.alias("r")), "rank")
        release(now)
        now = after
    j = nodes.join(now.select(F.col("id").alias("_id"), "r"), F.col("id") == F.col("_id"))
    return j.select("id", "n_citing", "n_cited_by", F.round("r", 9).alias("rank"))
