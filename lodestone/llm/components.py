"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, scratch


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) from links a, b; one row a node that has a link.

    Each round gives every node the least label among its neighbours and its own, then the label of
    that label; rounds end when nothing changes. The tables of earlier rounds are removed as it goes.
    Rows with a null end are ignored. No links give no rows.
    """
    both = scratch(links.select("a", "b").union(links.select("b", "a")).dropna().distinct(), "edges")
    # before the first round a node's label is the least of itself and its neighbours
    label = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    spent = []  # tables of earlier rounds
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = label.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("least"))
        least = scratch(least, "least")
        jump = least.select(F.col("node").alias("via"), F.col("least").alias("onward"))
        after = scratch(least.join(jump, F.col("least") == F.col("via")).select("node", F.col("onward").alias("label"), (F.col("onward") != F.col("label")).alias("moved")), "labels")
        label = after.select("node", "label")
        release(*spent, least)
        spent = [after]
        if not after.filter("moved").limit(1).count():
            release(both)
            return label
