"""A positional inverted index in Parquet: phrases by positions, ranked search by BM25.

Units are the texts that can be found: blocks, captions, translations, notes, questions, answers. An
index is written in segments; further units are a further segment. Units of one kind that lie together
form a shard, in the order of their ids; in a shard, every occurrence of a term has one number: the
terms of a unit are numbered on, and a number is left out between units, so that what follows one
another in a text, and nothing else, has numbers that follow one another. An index is one table:
  postings  segment, bucket, term, shard, kind, df (units), n (occurrences), data (their numbers)
A term's occurrences in a shard are one row, their differences in 7-bit bytes. The rows of bucket 16
have no term: they hold a shard's units (df: how many, n: terms, data: terms of each, unit_ids, source_ids).
A bucket's rows are sorted by term and dealt over as many files as they fill: a frequent term has a
row a shard. A search for given terms reads the folders of their buckets, and in these the row groups that can
hold them. Searching reads no text: the rows of the terms that are asked for meet by shard, each once,
whatever the number of queries.

Terms are runs of letters and digits in lower case. Nulls: a null or empty text holds no term; a
unit needs an id. A unit given twice counts twice in df and is found twice.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of an index that hold terms; the next one holds the units.
BUCKETS = 16
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Most units and terms of a shard (one unit may have more terms).
SHARD_UNITS, SHARD_TERMS = 65_536, 1_500_000
#: Parts of the shards that are searched at once, most queries that a part meets together, and most terms that are broadcast.
PARTS, TOGETHER, FEW = 64, 50_000, 200_000

_ROW = "shard long, kind string, term string, df long, n long, data binary, unit_ids array<string>, source_ids array<string>"


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _split(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]+"), 0)


def terms_of(text: Column) -> Column:
    """The terms of a text in their order."""
    return _split(_lower(text))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def encoded(values):
    """Bytes of numbers, the low seven bits first, and where each number's bytes end."""
    import numpy as np

    size = np.ones(len(values), np.int8)
    for k in range(1, 6):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size, dtype=np.int64)
    out, begin = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[begin[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def decoded(data: bytes):
    """The numbers that encoded() made bytes of."""
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128) + 1
    begin = np.concatenate([[0], ends[:-1]])
    size, out = ends - begin, np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (b[begin[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def _inverted(batches):
    """Units in the order of kind and id -> the rows of their shards."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    schema = pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("unit_ids", pa.list_(pa.string())), ("source_ids", pa.list_(pa.string()))])
    shard, ids = TaskContext.get().partitionId() << 20, pa.list_(pa.string())

    def rows(held):
        nonlocal shard
        t = pa.Table.from_batches(held).combine_chunks()
        terms = pa.concat_arrays(t["terms"].chunks)
        lens, kind = np.asarray(terms.value_lengths()).astype(np.int64), t["kind"][0].as_py()
        row = lambda c: pa.array([t[c].to_pylist()], ids)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([kind], pa.string()), pa.array([""]), pa.array([len(lens)]), pa.array([int(lens.sum())]), pa.array([encoded(lens)[0].tobytes()], pa.binary()), row("unit_id"), row("source_id")], schema=schema)
        if lens.sum():
            words = terms.flatten().dictionary_encode()
            number = np.arange(len(lens), dtype=np.int32)
            key = np.asarray(words.indices).astype(np.int64) << 32 | np.arange(int(lens.sum())) + np.repeat(number, lens)
            key.sort()
            begins = np.flatnonzero(np.diff(key >> 32, prepend=-1))
            at = key & 0xFFFFFFFF
            del key
            gaps = np.diff(at, prepend=0)
            gaps[begins] = at[begins]
            new = np.diff(np.repeat(number, lens + 1)[at], prepend=np.int32(-1)) != 0
            new[begins] = True
            data, ends = encoded(gaps)
            cuts = np.concatenate([[0], ends[begins[1:] - 1], ends[-1:]]).astype(np.int32)
            many, df, n = len(begins), np.add.reduceat(new.astype(np.int64), begins), np.diff(np.append(begins, len(at)))
            bytes_ = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
            out = [pa.array(np.full(many, shard)), pa.array([kind] * many, pa.string()), words.dictionary, pa.array(df), pa.array(n), bytes_, pa.nulls(many, ids), pa.nulls(many, ids)]
            whole = pa.RecordBatch.from_arrays(out, schema=schema)
            for k in range(0, many, 20_000):
                yield whole.slice(k, 20_000)
        shard += 1

    held, units, terms = [], 0, 0
    for batch in batches:
        kinds, sizes, begin = batch["kind"].to_pylist(), np.asarray(batch["terms"].value_lengths()), 0
        for k in range(batch.num_rows):
            last = held[-1]["kind"][0].as_py() if held and k == begin else kinds[k - 1]
            if (held or k > begin) and (kinds[k] != last or units == SHARD_UNITS or terms + sizes[k] > SHARD_TERMS):
                yield from rows(held + [batch.slice(begin, k - begin)] * (k > begin))
                held, units, terms, begin = [], 0, 0, k
            units, terms = units + 1, terms + int(sizes[k])
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield from rows(held)


def build(units: DataFrame, folder: str) -> None:
    """Add a segment with the units (unit_id, kind, source_id, text) to the index in ``folder``; the first makes the index.

    Terms are inverted where the units are read, so that what is dealt over the files is no larger than the index.
    """
    s = lambda c: F.col(c).cast("string").alias(c)
    # lowered before rows are sorted: of lower(upper(x)), Spark makes lower(x), which leaves ß as it is
    u = units.select(s("unit_id"), s("kind"), s("source_id"), _lower(F.col("text")).alias("lower")).sortWithinPartitions("kind", "unit_id")
    p = u.select("unit_id", "kind", "source_id", _split(F.col("lower")).alias("terms")).mapInArrow(_inverted, _ROW)
    p = p.withColumn("bucket", F.when(F.col("term") == "", BUCKETS).otherwise(_bucket(F.col("term"))))
    order = ["bucket", "term", "shard"]
    p.hint("rebalance", "bucket").sortWithinPartitions(*order).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings/segment={uuid.uuid4().hex}")


class Index:
    """An index that has been built; kinds: only units of these count and are found."""

    def __init__(self, spark: SparkSession, folder: str, kinds: list[str] | None = None):
        self.spark, self.kinds = spark, kinds
        rows = spark.read.schema(f"{_ROW}, segment string, bucket int").parquet(f"{folder}/postings")
        if kinds is not None:
            rows = rows.filter(F.col("kind").isin(kinds))
        self.postings, self.units = rows.filter(F.col("bucket") < BUCKETS).drop("unit_ids", "source_ids"), rows.filter(F.col("bucket") == BUCKETS)

    def _given(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of given terms: their buckets are constants, so that other folders aren't read."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term")).alias("b"))
        buckets = sorted({r["b"] for r in wanted.collect()}) if terms else []  # as many rows as terms
        return table.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _dealt(self, queries: DataFrame, postings: DataFrame, terms: DataFrame, most: int) -> DataFrame:
        """What each part of the shards needs, in the order in which it is searched: the queries, then shard by shard its units and its rows of the terms asked for.

        queries: query_id, terms, hash. terms: chunk, term, idf. A part meets at most about TOGETHER queries at once (a chunk of them).
        """
        shards = self.units.count()
        parts = max(1, min(PARTS, shards))
        chunk = lambda of: F.pmod(of, F.lit(most)).cast("int")
        at = F.pmod(F.xxhash64("segment", "shard"), F.lit(parts)).cast("int")
        none = {c: F.lit(None).cast(t) for c, t in {"query_id": queries.schema["query_id"].dataType, "terms": "array<string>", "idf": "double", "term": "string", "kind": "string", "n": "long", "data": "binary", "unit_ids": "array<string>", "source_ids": "array<string>"}.items()}
        full = lambda df, **has: df.select("part", *[has.get(c, F.lit(d)).alias(c) for c, d in (("segment", ""), ("shard", -1))], *[F.col(c) if c in df.columns else none[c].alias(c) for c in none])
        parted = queries.select("query_id", "terms", chunk(F.col("hash")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"))
        asked = full(parted.select((F.col("chunk") * parts + F.col("at")).alias("part"), "query_id", "terms"))
        every = self.units.select("segment", "shard", "kind", "data", "unit_ids", "source_ids", "term", at.alias("at"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("chunk"))
        where = {"segment": F.col("segment"), "shard": F.col("shard")}
        held = full(every.withColumn("part", F.col("chunk") * parts + F.col("at")), **where)
        met = postings.select("segment", "shard", "kind", "n", "data", "term").join(terms, "term").withColumn("part", F.col("chunk") * parts + at)
        rows = asked.unionByName(held).unionByName(full(met, **where))
        return rows.repartition(parts * most, "part").sortWithinPartitions("part", "segment", "shard", "term")

    def _terms(self, queries: DataFrame, postings: DataFrame, idf: Column) -> tuple[DataFrame, DataFrame, int]:
        """queries with their hash; chunk, term, idf of the terms that the index has; how many chunks."""
        most = 1 + queries.count() // TOGETHER
        q = queries.withColumn("hash", F.xxhash64("query_id"))
        wanted = q.select(F.pmod("hash", F.lit(most)).cast("int").alias("chunk"), F.explode("terms").alias("term")).distinct()
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
        df = postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        known = wanted.join(df, "term").select("chunk", "term", idf.alias("idf"))
        return q, F.broadcast(known) if known.count() <= FEW else known, most

    def phrase(self, text: str) -> DataFrame:
        """unit_id, kind, source_id, n_hits, first (position, from 0) of units that hold the text's terms one after the other."""
        terms = re.findall(r"[^\W_]+", text.lower())
        asked = self.spark.createDataFrame([("", terms, 0)], "query_id string, terms array<string>, hash long")
        given = list(dict.fromkeys(terms))
        known = self.spark.createDataFrame([(0, t, 0.0) for t in given], "chunk int, term string, idf double")
        return self._phrases(self._dealt(asked, self._given(self.postings, given), F.broadcast(known), 1), asked).drop("query_id")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """query_id and what phrase() returns, for a table of queries (query_id, text) of any size.

        In a shard, a phrase's rarest term says where it can begin; the other terms' numbers are looked up there.
        """
        q = queries.select("query_id", terms_of(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
        asked, known, most = self._terms(q, self.postings, F.lit(0.0))
        return self._phrases(self._dealt(asked, self.postings, known, most), q)

    def _phrases(self, dealt: DataFrame, queries: DataFrame) -> DataFrame:
        kind = queries.schema["query_id"].dataType.simpleString()
        return dealt.mapInArrow(_phrases_found, f"query_id {kind}, unit_id string, kind string, source_id string, n_hits long, first long")

    def bm25(self, queries: DataFrame, most: int = 10) -> DataFrame:
        """query_id, rank, unit_id, kind, source_id, score: each query's ``most`` best units by BM25, to six places; ties to the smaller unit_id.

        queries: query_id, text; a term counts once a query. Scores are added shard by shard, in the order of terms, and every
        part of the shards sends its best alone.
        """
        q = queries.select("query_id", F.array_sort(F.array_distinct(terms_of(F.col("text")))).alias("terms")).filter(F.size("terms") > 0)
        size = self.units.agg(F.sum("df").alias("u"), F.sum("n").alias("t")).first()
        count, mean = size["u"] or 0, (size["t"] or 0) / max(size["u"] or 0, 1)
        idf = F.log(1 + (F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked, known, chunks = self._terms(q, self.postings, idf)
        mean = float(mean or 1)
        kind = q.schema["query_id"].dataType.simpleString()
        s = self._dealt(asked, self.postings, known, chunks).mapInArrow(lambda batches: _best(batches, most, mean), f"query_id {kind}, unit_id string, kind string, source_id string, score double")
        best = [F.desc("score"), F.col("unit_id")]
        s = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("long")).filter(F.col("rank") <= most)
        return s.select("query_id", "rank", "unit_id", "kind", "source_id", "score")


class _Shard:
    """One shard's units, and the occurrences of the terms asked for, one term after the other."""

    def __init__(self, row, terms, counts, idf, data):
        import numpy as np

        self.kind, self.unit_ids, self.source_ids = row["kind"], row["unit_ids"], row["source_ids"]
        self.lens = decoded(row["data"])
        self.begins = np.concatenate([[0], np.cumsum(self.lens + 1)])
        n = np.array(counts, np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(n)])
        gaps = decoded(b"".join(data))
        total = np.cumsum(gaps)
        first = self.cuts[:-1]
        self.at = total - np.repeat(total[first] - gaps[first], n)
        self.unit = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens + 1)[self.at]
        self.term, self.idf = {t: k for k, t in enumerate(terms)}, np.array(idf)


def _shards(batches):
    """(queries, None, last) when a part's queries are known, then (queries, shard) for each of its shards; queries: terms -> numbers of query_ids."""
    part, queries, row, rows, ids = None, {}, None, [], []

    def shard():
        return _Shard(row, *zip(*rows)) if row is not None and rows else None

    for batch in batches:
        kind = batch.schema.field("query_id").type
        b = {c: batch[c].to_pylist() for c in ("part", "shard", "query_id", "terms", "term", "kind", "n", "idf", "data")}
        for k in range(batch.num_rows):
            if b["shard"][k] < 0:  # a query
                if b["part"][k] != part:
                    if (s := shard()) is not None:
                        yield queries, s, ids, kind
                    row, rows = None, []
                    yield queries, None, ids, kind
                    part, queries, ids = b["part"][k], {}, []
                queries.setdefault(tuple(b["terms"][k]), []).append(len(ids))
                ids.append(b["query_id"][k])
            elif b["term"][k] == "":  # a shard's units
                if (s := shard()) is not None:
                    yield queries, s, ids, kind
                if b["part"][k] != part:  # without queries
                    yield queries, None, ids, kind
                    part, queries, ids = b["part"][k], {}, []
                rows, row = [], {"kind": b["kind"][k], "data": b["data"][k], "unit_ids": batch["unit_ids"][k].values, "source_ids": batch["source_ids"][k].values}
            else:
                rows.append((b["term"][k], b["n"][k], b["idf"][k], b["data"][k]))
    if (s := shard()) is not None:
        yield queries, s, ids, kind
    if part is not None:
        yield queries, None, ids, kind


def _phrases_found(batches):
    import numpy as np
    import pyarrow as pa

    for queries, s, ids, type_ in _shards(batches):
        if s is None:
            continue
        ids = pa.array(ids, type_)
        out = []  # numbers of queries, units, hits, first
        for terms, asking in queries.items():
            known = [s.term.get(t) for t in terms]
            if None in known:
                continue
            spans = [s.at[s.cuts[g] : s.cuts[g + 1]] for g in known]
            rare = min(range(len(terms)), key=lambda k: len(spans[k]))
            at = spans[rare] - rare
            for k, span in enumerate(spans):
                if k != rare and len(at):
                    i = np.searchsorted(span, at + k)
                    at = at[span[np.minimum(i, len(span) - 1)] == at + k]
            if len(at):
                unit = np.searchsorted(s.begins, at, "right") - 1
                u, first, hits = np.unique(unit, return_index=True, return_counts=True)
                for q in asking:
                    out.append((np.full(len(u), q), u, hits, at[first] - s.begins[u]))
        if out:
            q, u, hits, first = map(np.concatenate, zip(*out))
            batch = pa.RecordBatch.from_arrays([ids.take(pa.array(q)), s.unit_ids.take(pa.array(u)), pa.array([s.kind] * len(u), pa.string()), s.source_ids.take(pa.array(u)), pa.array(hits.astype(np.int64)), pa.array(first)], ["query_id", "unit_id", "kind", "source_id", "n_hits", "first"])
            for k in range(0, len(u), 50_000):
                yield batch.slice(k, 50_000)


def _best(batches, most: int, mean: float):
    import numpy as np
    import pyarrow as pa

    best: dict = {}  # terms -> (-millionths of score, unit_id, kind, source_id), the best first
    for queries, s, ids, type_ in _shards(batches):
        if s is None:
            rows = [(q, *x) for terms, found in best.items() for q in queries[terms] for x in found]
            best = {}
            for k in range(0, len(rows), 50_000):
                q, score, unit, kind, source = zip(*rows[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in q], type_), pa.array(unit, pa.string()), pa.array(kind, pa.string()), pa.array(source, pa.string()), pa.array(np.array(score) / -1e6)], ["query_id", "unit_id", "kind", "source_id", "score"])
            continue
        new = np.diff(s.unit, prepend=np.int32(-1)) != 0
        new[s.cuts[:-1]] = True
        begins = np.flatnonzero(new)
        tf, unit = np.diff(np.append(begins, len(new))).astype(float), s.unit[begins]
        cuts = np.searchsorted(begins, s.cuts)
        idf = np.repeat(s.idf, np.diff(cuts))
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * s.lens[unit] / mean))
        score = np.zeros(len(s.lens))
        for terms in queries:
            known = [s.term[t] for t in terms if t in s.term]
            if not known:
                continue
            score[:] = 0
            for g in known:
                at = slice(cuts[g], cuts[g + 1])
                score[unit[at]] += part[at]
            have = best.get(terms, [])
            # no worse than the last of those that are known, give or take what rounding does
            got = np.flatnonzero(score >= (-have[-1][0] - 1) / 1e6) if len(have) == most else np.flatnonzero(score)
            if not len(got):
                continue
            points = np.floor(score[got] * 1e6 + 0.5)
            if len(got) > most:
                least = np.partition(points, -most)[-most]
                got, points = got[points >= least], points[points >= least]
                first = np.lexsort((got, -points))[:most]  # a shard's units are in the order of their ids
                got, points = got[first], points[first]
            found = [(-p, s.unit_ids[u].as_py(), s.kind, s.source_ids[u].as_py()) for p, u in zip(points.tolist(), got.tolist())]
            best[terms] = sorted(have + found, key=lambda x: x[:2])[:most]
