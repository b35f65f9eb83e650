"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length code, in the order of doc_id.

A token file set is a folder of three Parquet tables.
  ranks   rank, id: the ids from the most to the least frequent (ties by id; ids that never occur last)
  blocks  one row a block of whole documents: shard, block, offset (ids of its shard before it), n_ids,
          doc_ids and lengths (each document's id and number of ids), and two streams: control, data
  shards  shard, first: how many ids all earlier shards hold
Shards in order, and within them blocks in order, hold the documents in the order of doc_id. An id is
written as its rank in 1 to 4 little-endian bytes in ``data``. Four such lengths, less one, fill one byte
of ``control``, the first in the lowest bits; a last incomplete byte is filled up with zeros. So frequent
ids take one byte, and a reader finds all values of a control byte by one look into a table of 256 rows:
where each of 16 bytes comes from.

The tokenizers library encodes each text once, into a scratch table, beside which each task writes how often it
met each id; the table is dealt by ranges of doc_id. Only the ranks (as many as the vocabulary has) and one number a
shard come to the driver. Parquet is the container since any file system that Spark writes will do, and a
failed task leaves nothing behind.

Nulls: a null text counts as empty and holds the end id alone; null ids come first. Rows of equal
doc_id come in the order of their ids' hash, then of their ids; repeated rows give repeated results.
Other columns are passed by. An empty table gives tables without blocks, and no rows.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, scratch
from .byte_tokens import ALONE, read_text, tokenizer_for
from .common import arrow_map, pieces, text_of

#: Ids of a block at least, but for a shard's last.
BLOCK = 1 << 16
#: Ids of a shard: the smaller number up to MANY shards, then the larger.
SHARD = (1 << 22, 1 << 26)
MANY = 4096
#: Control bytes that are decoded at once.
STEP = 1 << 16


def packed_ids(ranks) -> tuple[bytes, bytes]:
    """The control and data streams of an array of ranks."""
    import numpy as np

    r = np.ascontiguousarray(ranks, dtype="<u4")
    extra, begin = np.zeros(len(r), np.uint8), np.arange(len(r))
    more = [np.flatnonzero(r > top) for top in (0xFF, 0xFFFF, 0xFFFFFF)]  # values of two, three and four bytes or more
    for k in more:
        extra[k] += 1
    begin += np.cumsum(extra, dtype=np.int64) - extra
    data, byte = np.empty(len(r) + sum(map(len, more)), np.uint8), r.view(np.uint8).reshape(-1, 4)
    data[begin] = byte[:, 0]
    for n, k in enumerate(more, 1):
        data[begin[k] + n] = byte[k, n]
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def decode_tables():
    """For each control byte: how many data bytes it tells of, and for each of 16 bytes of four values its place among them, or 16 (none)."""
    import numpy as np

    sizes = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
    before = np.cumsum(sizes, axis=1) - sizes
    byte = np.arange(4)
    place = np.where(byte < sizes[:, :, None], before[:, :, None] + byte, 16)
    return sizes.sum(axis=1).astype(np.int32), place.reshape(256, 16).astype(np.int32)


def unpacked_ids(control: bytes, data: bytes, n: int, id_of_rank):
    """The n ids of a block."""
    import numpy as np

    total, place = decode_tables()
    codes = np.frombuffer(control, np.uint8)
    out = np.empty(len(codes) * 4, np.uint32)
    # a last code that is not full tells of up to three bytes too many, and a place of 16 needs a byte to look at
    source = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(32, np.uint8)])
    start = 0
    for k in range(0, len(codes), STEP):
        part = codes[k : k + STEP]
        ends = np.cumsum(total[part], dtype=np.int32)
        where = place[part]
        none = where == 16
        where[1:] += ends[:-1, None]
        taken = source[start:].take(where)
        taken[none] = 0
        out[k * 4 : (k + len(part)) * 4] = taken.reshape(-1).view("<u4")
        start += int(ends[-1])
    return id_of_rank[out[:n]]


def width_of(size: int) -> str:
    """The numpy type of ids below ``size`` until they are packed: the narrower, the less is written and shuffled."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, pattern: str, end: int, size: int) -> DataFrame:
    """doc_id and the ids of each text with the end id, as bytes of little-endian integers; one row a document.

    At the end of each task, rows with id and n alone: how often it met the id, of ``size``.
    """
    width = width_of(size)
    data = docs.sparkSession.sparkContext.broadcast(read_text(path))

    def run(batches):
        import numpy as np

        tok, seen = tokenizer_for(path, True, pattern, data), np.zeros(size, np.int64)
        tok.times = ALONE
        names = ["doc_id", "ids", "id", "n"]
        for ids, texts in pieces(batches, ["doc_id", "text"], 1_500_000):
            flat, lengths, _ = tok.encode([text_of(t) for t in texts])
            seen += np.bincount(flat, minlength=size)
            seen[end] += len(lengths)
            whole = np.insert(flat, np.cumsum(lengths), end).astype(width).tobytes()
            at = np.concatenate([[0], np.cumsum(lengths + 1)]) * int(width[2])
            rows = [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), none, none], names)
        met = np.flatnonzero(seen)
        yield pa.record_batch([pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.binary()), pa.array(met, pa.int64()), pa.array(seen[met])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, ids binary, id long, n long")


def write(docs: DataFrame, folder: str, path: str, pattern: str, end: int) -> None:
    """Encode every whole text, append the end id, and write a token file set to a new folder."""
    import json

    import numpy as np

    spark = docs.sparkSession
    vocabulary = json.loads(read_text(path))
    size = 1 + max(end, *vocabulary["model"]["vocab"].values(), *[t["id"] for t in vocabulary["added_tokens"]])
    width = width_of(size)
    held = scratch(encoded(docs, path, pattern, end, size), "token-ids", "zstd")
    counts = np.zeros(size, np.int64)
    for r in held.filter("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many as the vocabulary has
        counts[r["id"]] = r["n"]
    order = np.lexsort([np.arange(size), -counts])
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size)
    spark.createDataFrame(pa.table({"rank": np.arange(size), "id": order})).coalesce(1).write.parquet(f"{folder}/ranks")
    ranks, total = spark.sparkContext.broadcast(rank_of), int(counts.sum())

    def run(batches):
        shard, block, offset, many, ids, docs_, lengths = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def row():
            control, data = packed_ids(ranks.value[np.concatenate(ids)])
            cols = [[shard], [block], [offset], [many], [docs_], [lengths], [control], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "block", "offset", "n_ids", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(np.frombuffer(x.as_py(), width))
                docs_.append(doc)
                lengths.append(len(ids[-1]))
                many += lengths[-1]
                if many >= BLOCK:
                    yield row()
                    block, offset, many, ids, docs_, lengths = block + 1, offset + many, 0, [], [], []
        if ids:
            yield row()

    shards = max(1, min(MANY, -(-total // SHARD[0])), -(-total // SHARD[1]))
    order_by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    sorted_ = held.filter("n IS NULL").select("doc_id", "ids").repartitionByRange(shards, *order_by).sortWithinPartitions(*order_by, "ids")
    arrow_map(sorted_, run, "shard int, block int, offset long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/blocks")
    release(held)
    rows = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    firsts, first = [], 0
    for r in rows:  # one number a shard
        firsts.append((r["shard"], first))
        first += r["n"]
    spark.createDataFrame(firsts, "shard int, first long").coalesce(1).write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Documents of a token file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless left out, ids.

    ids_crc32 is the unsigned CRC-32 of the ids as little-endian uint32.
    """
    import numpy as np

    order = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    table = spark.sparkContext.broadcast(order)
    blocks = spark.read.parquet(f"{folder}/blocks").drop("block")
    firsts = F.broadcast(spark.read.parquet(f"{folder}/shards"))  # two numbers a shard
    rows = blocks.join(firsts, "shard").select((F.col("first") + F.col("offset")).alias("start"), "n_ids", "doc_ids", "lengths", "control", "data")

    def run(batches):
        for batch in batches:
            for start, n, docs, lengths, control, data in zip(*[c.to_pylist() for c in batch.columns]):
                found = unpacked_ids(control, data, n, table.value).astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)])
                parts = [found[i:j] for i, j in zip(at[:-1], at[1:])]
                cols = [pa.array(docs, pa.int64()), pa.array(start + at[:-1]), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                if ids:
                    cols.append(pa.array(parts, pa.list_(pa.int64())))
                yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return arrow_map(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
