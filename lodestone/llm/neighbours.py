"""Approximate nearest neighbours by inner product with a permutation index.

Every vector is represented by its NEAREST nearest pivots in order. Blocks of vectors hold these
as inverted files: for each pivot, the rows that list it and at which place. A query adds up, over
the files of its own pivots, how far the places agree (the footrule distance, a missing pivot
counting as the place behind the last), all files in one addition; the best SHARE of a block by that distance, DEPTH times the
number asked for at least, is reranked by the inner product in double precision, and the best of all
blocks are returned.

Inner products order vectors like distances once each has been given one more coordinate that
brings it to the largest norm, and so the pivots are compared in that space. The pivots are a
bounded sample (PIVOTS vectors, by hash of the id); every row is indexed. Queries meet all blocks
of candidates; blocks are of bounded size, and so is every group.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do null ids. Rows that share a vec_id are vectors of their own: each
is found, and each is a query with results of its own, in which no row of its vec_id is found. Ties go to the
smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

PIVOTS = 512
NEAREST = 64
SHARE = 0.25
DEPTH = 10
CANDIDATES = 8192
QUERIES = 16384
_RESULT = "query_id long, row long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) and row (a number of its own) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropna()
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(fine & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("row", F.monotonically_increasing_id())


def permutations(x, pivots, longest: float, is_query: bool):
    """The numbers of each row's nearest pivots, nearest first; ties to the earlier pivot."""
    import numpy as np

    norms = np.sqrt((x * x).sum(axis=1))
    if is_query:
        x = x * (longest / norms)[:, None]
        near = x @ pivots[:, :-1].T
    else:
        rest = np.sqrt(np.maximum(longest**2 - norms**2, 0))
        near = np.concatenate([x, rest[:, None]], axis=1) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, : min(NEAREST, len(pivots))].astype(np.int16)


class Block:
    """A block of vectors with its inverted files."""

    def __init__(self, ids, x, pivots, longest: float):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        _, first, which = np.unique(x[order], axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(first, kind="stable")  # distinct vectors by their smallest id
        self.x = x[order][first[rank]]
        number = np.empty_like(rank)
        number[rank] = np.arange(len(rank))
        which = number[which.ravel()]
        by_entry = np.argsort(which, kind="stable")
        self.ids, self.edges = ids[order][by_entry], np.searchsorted(which[by_entry], np.arange(len(rank) + 1))
        perm = permutations(self.x, pivots, longest, False)
        self.places = perm.shape[1]
        flat = perm.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        #: The inverted files, one behind the other: rows, and at which place each lists the file's pivot.
        self.listed, self.place = (by_pivot // self.places).astype(np.int32), (by_pivot % self.places).astype(np.int16)
        self.file_edges = edges.tolist()

    def search(self, query_id: int, q, perm, k: int):
        """(ids, scores) of the ``k`` best rows for one query, best first."""
        import numpy as np

        files = [(self.file_edges[pivot], self.file_edges[pivot + 1]) for pivot in perm.tolist()]
        own = np.repeat(np.arange(len(files), dtype=np.int16), [b - a for a, b in files])
        near = self.places - np.abs(np.concatenate([self.place[a:b] for a, b in files]) - own)
        agree = np.bincount(np.concatenate([self.listed[a:b] for a, b in files]), near, len(self.x))  # whole numbers
        take = min(len(agree), max(DEPTH * k, int(len(agree) * SHARE)))
        if take < len(agree):
            least = np.partition(agree, len(agree) - take)[len(agree) - take]
            better = np.flatnonzero(agree > least)
            equal = np.flatnonzero(agree == least)[: take - len(better)]
            rows = np.concatenate([better, equal])
        else:
            rows = np.arange(len(agree))
        near = self.x[rows] @ q
        most = k + int((self.ids == query_id).sum())  # so many entries may be the query's own alone
        if len(rows) > most:
            bar = np.partition(near, len(near) - most)[len(near) - most]
            rows = rows[near >= bar - 1e-9 * (1 + abs(bar))]
        exact = np.cumsum(self.x[rows] * q, axis=1)[:, -1]  # one order of addition for all rows
        ids = [self.others(a, b, query_id, k) for a, b in zip(self.edges[rows], self.edges[rows + 1])]
        exact = np.repeat(exact, [len(i) for i in ids])
        ids = np.concatenate(ids)
        best = np.lexsort((ids, -exact))[:k]
        return ids[best], exact[best]


    def others(self, a: int, b: int, query_id: int, k: int):
        """The first k ids of an entry but the query's own; they are in order."""
        import numpy as np

        lo = a + np.searchsorted(self.ids[a:b], query_id)
        hi = a + np.searchsorted(self.ids[a:b], query_id, "right")
        return self.ids[a : min(b, a + k)] if lo == hi else np.concatenate([self.ids[a:lo], self.ids[hi:b]])[:k]


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` nearest of every vector for which ``is_query`` (a Column of vec_id) holds."""
    import numpy as np

    spark = vectors.sparkSession
    rows = scratch(usable(vectors), "vectors")
    dim = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == dim[0]["d"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(norm).alias("longest")).collect()[0]
    n, queries, longest = seen["n"], seen["q"], seen["longest"]
    sample = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "embedding").limit(PIVOTS).collect()
    p = np.array([r["embedding"] for r in sample])
    rest = np.sqrt(np.maximum(longest**2 - (p * p).sum(axis=1), 0))
    shared = spark.sparkContext.broadcast((np.concatenate([p, rest[:, None]], axis=1), longest))
    left, right = -(-n // CANDIDATES), max(1, -(-queries // QUERIES))

    def cells(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int").alias(mine)
        return df.select("vec_id", "embedding", "row", block, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    candidates = cells(rows, left, right, "cb", "qb")
    # columns of their own: of a table joined with itself, Spark may prune those of one side
    asked = cells(rows.filter(is_query), right, left, "qb", "cb").toDF("query_id", "vector", "query_row", "query_qb", "query_cb")

    def meet(key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        pivots, most = shared.value
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []})
        block = Block(c.vec_id.to_numpy(), np.stack(c.embedding.to_numpy()), pivots, most)
        x = np.stack(q.vector.to_numpy())
        perms = permutations(x, pivots, most, True)
        out = [block.search(i, v, perm, k) for i, v, perm in zip(q.query_id.to_numpy(), x, perms)]
        many = [len(o[0]) for o in out]
        return pd.DataFrame({"query_id": np.repeat(q.query_id.to_numpy(), many), "row": np.repeat(q.query_row.to_numpy(), many), "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out])})

    found = candidates.groupBy("cb", "qb").cogroup(asked.groupBy("query_cb", "query_qb")).applyInPandas(meet, _RESULT)
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
