"""Two versions of a source's blocks: what was kept, moved, edited, added, removed, and anchors carried over.

Kept blocks are a longest common subsequence of the two versions' digests: of all the longest, the one
whose last pair lies first in the new version, then first in the old one, and so on from the back. What is
left over with an equal digest on both sides has moved (first with first). In a gap between kept blocks,
the first old and the first new block that are left make an edited one, if they are of one kind at the
same place of the gap; the rest is removed or added.

Only digests are gathered, a source's at a time. Common beginnings and ends need no search; in between,
a row of the usual table is a bit string (a set bit: no longer than without that new block), made from the
row before by one addition, and every so many rows one is kept to walk back from: 100,000 blocks on
both sides take some seconds and a few megabytes.

Nulls: a null text or kind is an empty one. A source with one version has added or removed blocks alone. Blocks
of equal idx come in the order of their ids.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_rows(old: list, new: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; see the module's text for which."""
    first = 0
    while first < min(len(old), len(new)) and old[first] == new[first]:
        first += 1
    # the end may only be cut where no earlier pair could take its place: that is left to the walk
    a, b = old[first:], new[first:]
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    every = max(1, int(len(a) ** 0.5))
    row, kept = full, {0: full}
    for i, x in enumerate(a, 1):
        row = _next(row, places.get(x, 0), full)
        if i % every == 0:
            kept[i] = row
    out, i, j, held = [], len(a), len(b), {}

    def at(n: int) -> int:
        if n not in held:
            start = n - n % every
            held.clear()
            held[start] = kept[start]
            for m in range(start + 1, min(start + every, len(a) + 1)):
                held[m] = _next(held[m - 1], places.get(a[m - 1], 0), full)
        return held[n]

    def length(n: int, m: int) -> int:
        return m - (at(n) & ((1 << m) - 1)).bit_count()

    want = length(i, j)
    while want:
        rising = ~at(i) & ((1 << j) - 1)  # the ends at which the row grows; the last of them is the least place
        j = rising.bit_length()
        while length(i - 1, j) == want:
            i -= 1
        out.append((first + i - 1, first + j - 1))
        i, j, want = i - 1, j - 1, want - 1
    return [(k, k) for k in range(first)] + out[::-1]


def _next(row: int, hits: int, full: int) -> int:
    x = row & hits
    return ((row + x) | (row - x)) & full


def kept_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, old_no, new_no: the kept blocks. old, new: source_id, no, digest."""
    side = lambda b: b.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "digest"))), lambda r: r["digest"]).alias("digests"))
    both = side(old).withColumnRenamed("digests", "a").join(side(new).withColumnRenamed("digests", "b"), "source_id")

    def run(batches):
        for batch in batches:
            for source, a, b in zip(batch["source_id"], batch["a"], batch["b"]):
                found = common_rows(list(a), list(b))
                if found:
                    yield pd.DataFrame({"source_id": source, "old_no": [x for x, _ in found], "new_no": [y for _, y in found]})

    return both.mapInPandas(run, f"source_id {old.schema['source_id'].dataType.simpleString()}, old_no long, new_no long")


def _numbered(blocks: DataFrame) -> DataFrame:
    """source_id, no, id, idx, kind and digest (of kind and text) of one version."""
    digest = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce("kind", F.lit("")), F.coalesce("text", F.lit("")))))
    no = F.row_number().over(Window.partitionBy("source_id").orderBy("idx", "id")) - 1
    return blocks.select("source_id", no.cast("long").alias("no"), "id", F.col("idx").cast("long").alias("idx"), F.coalesce("kind", F.lit("")).alias("kind"), digest.alias("digest"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, change, old_id, old_idx, new_id, new_idx: one row for each block of either version, and one for both of a pair.

    old, new: source_id, id, idx, kind, text. change: kept, moved, edited, added or removed.
    """
    o, n = _numbered(old), _numbered(new)
    kept = kept_pairs(o, n)
    o = o.withColumnsRenamed({"no": "old_no", "id": "old_id", "idx": "old_idx"}).join(kept, ["source_id", "old_no"], "left")
    n = n.withColumnsRenamed({"no": "new_no", "id": "new_id", "idx": "new_idx"}).join(kept.withColumnRenamed("old_no", "of"), ["source_id", "new_no"], "left")

    def parted(b: DataFrame, no: str, other: str) -> DataFrame:
        gap = F.count(other).over(Window.partitionBy("source_id").orderBy(no))  # kept blocks so far
        nth = F.row_number().over(Window.partitionBy("source_id", "digest", F.col(other).isNull()).orderBy(no))
        return b.withColumn("gap", gap).withColumn("nth", nth)

    o, n = parted(o, "old_no", "new_no"), parted(n, "new_no", "of")
    same = o.filter("new_no IS NOT NULL").select("source_id", "new_no", "old_id", "old_idx")
    same = same.join(n.filter("of IS NOT NULL").select("source_id", "new_no", "new_id", "new_idx"), ["source_id", "new_no"])
    lost = o.filter("new_no IS NULL").drop("new_no").withColumnRenamed("gap", "old_gap").withColumnRenamed("kind", "old_kind")
    found = n.filter("of IS NULL").drop("of").withColumnRenamed("gap", "new_gap").withColumnRenamed("kind", "new_kind")
    met = lost.join(found, ["source_id", "digest", "nth"], "full")
    moved = met.filter("old_id IS NOT NULL AND new_id IS NOT NULL")

    def placed(b: DataFrame, gap: str, no: str) -> DataFrame:
        return b.withColumn("place", F.row_number().over(Window.partitionBy("source_id", gap).orderBy(no)))

    left = placed(met.filter("new_id IS NULL").select("source_id", "old_no", "old_id", "old_idx", "old_kind", F.col("old_gap").alias("gap")), "gap", "old_no")
    came = placed(met.filter("old_id IS NULL").select("source_id", "new_no", "new_id", "new_idx", "new_kind", F.col("new_gap").alias("gap")), "gap", "new_no")
    left, came = left.withColumnRenamed("old_kind", "kind"), came.withColumnRenamed("new_kind", "kind")
    rest = left.join(came, ["source_id", "gap", "place", "kind"], "full")
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").otherwise("edited")
    cols = ["old_id", "old_idx", "new_id", "new_idx"]
    out = same.select("source_id", F.lit("kept").alias("change"), *cols)
    out = out.unionByName(moved.select("source_id", F.lit("moved").alias("change"), *cols))
    return out.unionByName(rest.select("source_id", change.alias("change"), *cols))


def carried(anchors: DataFrame, diff: DataFrame) -> DataFrame:
    """anchors (source_id, block_id and others) with new_block_id and carry: kept, moved, edited, or lost (the block is gone, or was never there)."""
    to = diff.filter("old_id IS NOT NULL AND new_id IS NOT NULL").select(F.col("source_id").alias("_s"), F.col("old_id").alias("_o"), F.col("new_id").alias("new_block_id"), F.col("change").alias("carry"))
    j = anchors.join(to, (F.col("source_id") == F.col("_s")) & (F.col("block_id") == F.col("_o")), "left").drop("_s", "_o")
    return j.withColumn("carry", F.coalesce("carry", F.lit("lost")))
