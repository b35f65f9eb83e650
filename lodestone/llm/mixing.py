"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key: minus the logarithm of a number in (0, 1) hashed from its
id and text, divided by its quality weight. Within a source, documents are taken in the order of
their keys until the source's word budget is met; complete epochs of the source come first, and
the keys choose the rest. The cut falls where the sum of sizes comes nearest to the budget.

The order is never built in one task: sums of sizes by 256 ranges of the key per source give the
range that holds the cut, three times over, and only the documents of the last range are sorted.
A source's cut is then one key, so that the choice for each document is a comparison.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; a target stops at 3 times
its source's size and what exceeds it is shared anew by weight. In closed form, the target is the
smaller of that bound and the weight times one common rate.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id counts
as an empty text in the hash. Rows equal in id and text have one key and are taken together.
Empty texts take no words. Other columns stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .common import arrow_map, packed, pieces, text_of, unit_hash, unpacked, words_of

MOST = 3
LEVELS = 3
SEED = "mix-1"
_SYMBOLS = b"#*$%&|<>"


def sized(docs: DataFrame) -> DataFrame:
    """The rows with _size (words) and _marks (symbol characters) behind their own columns."""
    fields = docs.schema.names

    def run(batches):
        for batch in batches:
            at = fields.index("text")
            size, marks = [], []
            for (texts,) in pieces([pa.record_batch([batch.column(at)], ["text"])], ["text"]):
                for t in texts:
                    t = text_of(t)
                    size.append(len(words_of(t)))
                    data = t.encode()
                    marks.append(len(data) - len(data.translate(None, _SYMBOLS)))
            yield pa.record_batch([*batch.columns, pa.array(size, pa.int64()), pa.array(marks, pa.int64())], [*fields, "_size", "_marks"])

    rows = docs.withColumn("text", F.col("text").cast("string"))
    added = [T.StructField("_size", T.LongType()), T.StructField("_marks", T.LongType())]
    return arrow_map(rows, run, T.StructType([*rows.schema.fields, *added]))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with _size and _key; the weight falls with the share of symbol characters."""
    u = unit_hash(F.lit(SEED), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    per_weight = F.when(F.col("_size") > 0, (F.col("_size") + F.col("_marks")) / F.col("_size")).otherwise(F.lit(1.0))
    return sized(docs).withColumn("_key", -F.log(u) * per_weight).drop("_marks")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target, epochs and rest (words to take by keys); a row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    bound = MOST * F.col("source_size")
    ratio = Window.orderBy((bound / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, every = ratio.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    w = w.select("*", F.sum("source_size").over(every).alias("total"), (F.sum(bound).over(upto) - bound).alias("met"), (F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")).alias("left"))
    # the first source, by bound to weight, that the rate doesn't bring to its bound; all later ones share that rate
    w = w.withColumn("rate", (F.col("total") - F.col("met")) / F.col("left"))
    rate = F.first(F.when(F.col("rate") * F.col("weight") <= bound, F.col("rate")), True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("common", rate)
    w = w.withColumn("target", F.coalesce(F.least(bound.cast("double"), F.col("weight") * F.col("common")), bound.cast("double")))
    whole = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(whole / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    return w.select("source", "source_size", "target", epochs.alias("epochs"), (whole - epochs * F.col("source_size")).cast("long").alias("rest"))


def cell(level: int):
    """The key's range at a level: 256 ** level ranges of equal shares, in the order of the keys."""
    share = F.floor((1 - F.exp(-F.col("_key"))) * float(256**level)).cast("long")
    return F.least(share, F.lit(256**level - 1).cast("long"))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with cut_key, cut_id and cut_size of the last document that each source takes by key.

    rows: source, doc_id, _size, _key. Null cut_key: none is taken.
    """
    state = plan.select(F.col("source").alias("of"), F.col("rest"), F.lit(0).cast("long").alias("inside")).filter("rest > 0")
    near = rows
    for level in range(1, LEVELS + 1):
        last = cell(level - 1)
        here = near.join(state, F.col("source").eqNullSafe(F.col("of")) & (last == F.col("inside")))
        sums = here.groupBy("of", "rest", cell(level).alias("cell")).agg(F.sum("_size").alias("words"))
        w = Window.partitionBy("of").orderBy("cell")
        sums = sums.withColumn("before", F.sum("words").over(w) - F.col("words"))
        holds = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
        state = scratch(sums.filter(holds).select("of", (F.col("rest") - F.col("before")).alias("rest"), F.col("cell").alias("inside")), "cut")
    here = rows.join(state, F.col("source").eqNullSafe(F.col("of")) & (cell(LEVELS) == F.col("inside")))
    peers = here.groupBy("of", "rest", "_key", "doc_id", "_size").agg(F.sum("_size").alias("words"))
    w = Window.partitionBy("of").orderBy("_key", "doc_id", "_size")
    peers = peers.withColumn("before", F.sum("words").over(w) - F.col("words"))
    chosen = peers.filter(2 * F.col("before") + F.col("words") <= 2 * F.col("rest"))
    last = chosen.groupBy("of").agg(F.max(F.struct("_key", "doc_id", "_size")).alias("cut"))
    # where the range's first document is already too much, all ranges before it are taken
    floor = state.join(last.withColumnRenamed("of", "chosen_of"), F.col("of").eqNullSafe(F.col("chosen_of")), "left").select("of", "inside", "cut")
    return plan.join(floor, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "epochs", "rest", "inside", "cut")


def decided(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows with source_size, target and _copies (how often the mix takes the document)."""
    per = cut.withColumnRenamed("source", "of")
    j = rows.join(per, F.col("source").eqNullSafe(F.col("of")), "left")
    at = cell(LEVELS)
    by_key = F.when(F.col("rest") <= 0, False).when(at < F.col("inside"), True).when(at > F.col("inside"), False)
    by_key = by_key.otherwise(F.coalesce(F.struct("_key", "doc_id", "_size") <= F.col("cut"), F.lit(False)))
    copies = F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(by_key, F.lit(False)).cast("long")
    return j.withColumn("_copies", copies).drop("of", "epochs", "rest", "inside", "cut")


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = scratch(keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")).drop("text"), "mix")
    plan = scratch(targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size"))), "targets")
    return rows, scratch(cuts(rows, plan), "cuts")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every document."""
    rows, cut = _plan(docs)
    return decided(rows, cut).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as it is taken."""
    _, cut = _plan(docs)
    rows = keyed(packed(docs, "doc_id", "source", "text"))
    taken = decided(rows, cut).filter("_copies > 0")
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return unpacked(taken.withColumn("_nth", nth), docs, "doc_id", "source", "text")
