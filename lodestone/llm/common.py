"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

#: Words of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(text) -> str:
    """A text from Arrow; null counts as empty."""
    return text if text is not None else ""


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8 bytes; ``lower`` folds A-Z only.

    ``bytes.split`` breaks at space, tab, LF, VT, FF and CR, which is exactly WORD's complement.
    """
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from md5 of the parts, the same in every engine: 52 bits and a half step."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def pieces(batches, columns: list[str], limit: int = 4_000_000):
    """Arrow batches cut so that one cut holds at most ``limit`` bytes or one row; as column lists.

    It bounds the memory of a Python worker whatever the lengths of the texts are; no row is lost.
    """
    for batch in batches:
        n, start = batch.num_rows, 0
        sizes = _row_bytes(batch)
        while start < n:
            end, total = start + 1, sizes[start]
            while end < n and total + sizes[end] <= limit:
                total += sizes[end]
                end += 1
            part = batch.slice(start, end - start)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
            start = end


#: Rows of an Arrow batch at most: with texts, the default of 10,000 makes batches of tens of MB in each task.
BATCH_ROWS = 1000


def arrow_map(rows: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in small batches; workers give memory back after a partition.

    The batch size is a setting of the session and is read when the plan runs, so it stays lowered.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows.mapInArrow(tidy(run), schema)


def tidy(run):
    """``run`` over a partition's batches; afterwards the worker's unused memory goes back to the system.

    Workers are reused, so that what one partition needed would otherwise stay beside the next.
    """

    def whole(batches):
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()

    return whole


def _trim() -> None:
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _row_bytes(batch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    out = np.full(batch.num_rows, 64, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            out += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out.tolist()


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others inside one struct, _rest: no name of theirs can clash."""
    others = [F.col(f"`{n}`") for n in docs.columns if n not in used]
    return docs.select(*used, F.struct(*others or [F.lit(0).alias("none")]).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, *used: str, added: list[str] = ()) -> DataFrame:
    """The columns of ``docs`` in their order, from what packed() made of them, and ``added`` new ones."""
    return rows.select(*[F.col(n) if n in used else F.col(f"_rest.`{n}`").alias(n) for n in docs.columns], *added)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """_id and _label of every labelled id of the training rows, those whose id_bucket(doc_id, 4) is not 2; the maximum of several labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).dropna()
    return scratch(known.filter(id_bucket(F.col("_id"), 4) != 2).groupBy("_id").agg(F.max("_label").alias("_label")), "labels")


def id_filter(ids: DataFrame, name: str, many: int, most: int = 1 << 27):
    """A filter of bits (16 an id, ``most`` at most): the Column that gives a long's bit, and whether bits are set, as bytes.

    No id is lost; what passes by chance is for a join to drop.
    """
    import numpy as np

    size = min(most, 1 << max(15, (16 * many - 1).bit_length()))
    bits = ids.select((F.pmod(F.xxhash64(name), F.lit(size)) + 1).alias("bit"))  # Spark's bitmaps count from 1
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    held = np.zeros(size // 8, np.uint8)
    for r in maps:
        start = (r["n"] - 1) * 4096
        held[start : start + 4096] = np.frombuffer(r["map"], np.uint8)
    return lambda column: F.pmod(F.xxhash64(column), F.lit(size)), held


def summed(rows: DataFrame, run):
    """The sum of the int64 arrays, all of one length, that ``run`` makes of tasks' batches; None without any.

    Integers, so that the order of the tasks changes nothing; tasks are added on the executors, by levels.
    """
    import numpy as np
    import pyarrow as pa

    def task(batches):
        total = None
        for part in run(batches):
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = arrow_map(rows, task, "total binary").rdd.map(lambda r: np.frombuffer(r["total"], np.int64))
    return parts.treeAggregate(None, lambda a, b: b if a is None else a + b, lambda a, b: a if b is None else b if a is None else a + b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, longest: int = 200_000) -> tuple[list[str], list[int], list[str]]:
    """Texts, labels and languages of at most ``bound`` training documents, in a fixed order.

    Training rows are those whose id_bucket(doc_id, 4) is not 2. The ids are the first ``bound`` by
    hash, of the labelled ones; texts of over ``longest`` characters aren't trained on. The language
    serves to calibrate thresholds alone.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).dropna()
    known = known.filter(id_bucket(F.col("_id"), 4) != 2).groupBy("_id").agg(F.max("_label").alias("_label"))
    # in the order of md5, so that a threshold on it keeps the first ones: tasks send about 4 * bound rows in all
    digest = F.md5(F.col("_id").cast("string"))
    share = min(1.0, 4 * bound / max(1, known.count()))
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    ids = F.broadcast(known.filter(first).orderBy(digest, "_id").limit(bound))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    rows = rows.filter(F.coalesce(F.length("_text"), F.lit(0)) <= longest).join(ids, F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.coalesce("_text", F.lit("")).alias("t"), F.coalesce("_lang", F.lit("")).alias("l"))).alias("_x"))
    got = sorted(rows.collect(), key=lambda r: hash_of(r["_id"]))
    return [r["_x"]["t"] for r in got], [r["_label"] for r in got], [r["_x"]["l"] for r in got]


def hash_of(value) -> str:
    import hashlib

    return hashlib.md5(str(value).encode()).hexdigest()
