"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``width`` lower-cased words (A-Z only; a shorter
text is one shingle, an empty one has none). Rounds of hashing place every shingle into a bin of
the sketch with a value that grows from round to round; a bin keeps its least value. Random bins
come first, as many rounds as there are bins at most, then one round for each bin still empty, so
that every coordinate fills. BANDS bands of ROWS coordinates make the buckets: documents of
similarity 0.8 share none with probability (1 - 0.8**ROWS)**BANDS = 3e-6, more similar ones less.

Documents of equal word sequences are one class from the start. Within a bucket, the member that
shares most buckets with others is the centre, and all members are compared with it on their full
sets. Links make components. A centre is the hub of all members of its buckets; members of a hub
that lie in different components are then compared on their full sets too, in bounded blocks: those
outside the hub's component with all. Pairs within a component need no comparison, so no link
between components is lost, and no group of copies is expanded into pairs.

Nulls: a null text has no shingles and is linked with nothing, like an empty one. A null id is
above all others: a group's id is its least id that is not null. Rows of equal id and text are
one document and share their verdict; deduplicated() leaves one row of them. Other columns are passed
by. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import arrow_map, packed, pieces, text_of, unpacked, words_of
from .components import components

BANDS = 42
ROWS = 6
BINS = BANDS * ROWS
#: Blocks of classes compared set by set: those outside a hub's component, and all members.
ASIDE = 128
MEMBERS = 512
#: Bits of the filter that says which texts to read again for verification: 64 a class, 2 to 16 MB. When it
#: is full, more texts pass it than need to; what isn't wanted meets no pair.
FILTER_BITS = (1 << 24, 1 << 27)
#: Members of a centre whose sets meet one copy of the centre's set.
SHARE = 64


def mix(x):
    """A 64-bit mixing function on arrays of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], width: int):
    """The distinct shingles of a word list as sorted 64-bit hashes."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    take = min(width, len(words))
    x = np.full(len(h) - take + 1, take, dtype=np.uint64)
    for j in range(take):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(x)])
    return np.unique(x)


def sketch(shingles):
    """BINS coordinates: in each bin the round and value of the first shingle that reached it."""
    import numpy as np

    empty = np.uint64(2**64 - 1)
    out = np.full(BINS, empty, dtype=np.uint64)
    low, shift, gold = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(0x9E3779B97F4A7C15)
    first, many = 0, max(1, 1500 // len(shingles))
    while first < BINS:
        rounds = np.arange(first, min(BINS, first + many), dtype=np.uint64)[:, None]
        h = mix(shingles[None, :] + (rounds + np.uint64(1)) * gold)
        bins = ((h >> shift) * np.uint64(BINS)) >> shift
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds << shift) | (h & low)).ravel())
        first += len(rounds)
        if not (out == empty).any():
            return out
    for j in np.flatnonzero(out == empty):
        r = np.array([BINS + j], dtype=np.uint64)
        out[j] = (r << shift)[0] | (mix(shingles + (r + np.uint64(1)) * gold) & low).min()
    return out


def bands(coordinates):
    """A 64-bit key for each band, different bands never meeting but by chance."""
    import numpy as np

    c = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c[:, j])
    return key.view(np.int64)


def class_of(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, cls (null without words), n_shingles, and the band keys of a class's first row in a partition."""

    def run(batches):
        seen: set[bytes] = set()
        for ids, texts in pieces(batches, ["doc_id", "text"]):
            classes, sizes, keys = [], [], []
            for t in texts:
                words = words_of(text_of(t), lower=True)
                cls = class_of(words) if words else None
                found = shingle_set(words, width)
                classes.append(cls)
                sizes.append(len(found))
                keys.append(None if cls is None or cls in seen else bands(sketch(found)))
                seen.add(cls)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "cls", "n_shingles", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, cls binary, n_shingles long, bands array<long>")


def _bit(cls: bytes, doc_id, size: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(cls + str(doc_id).encode()) % size


def wanted_bits(wanted: DataFrame) -> tuple[int, bytes]:
    """A filter with the bits of the given cls, doc_id set: its size, and the bits."""
    import numpy as np

    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (64 * wanted.count()).bit_length()))

    def run(batches):
        for batch in batches:
            bits = np.unique([_bit(c, d, size) for c, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            if len(bits):
                yield pa.record_batch([pa.array(bits + 1, pa.int64())], ["bit"])  # Spark's bitmaps count from 1

    bits = arrow_map(wanted.select("cls", "doc_id"), run, "bit long")
    # at most size / 32768 rows, whatever the input
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    out = np.zeros(size // 8 + 8192, dtype=np.uint8)
    for r in rows:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] |= np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    return size, out.tobytes()


def full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """cls and the full shingle set of the wanted classes (cls, doc_id) and perhaps others, one row each; a written table.

    A class comes once from each partition that holds the row of its least id, so mostly once in all;
    of repeated rows all but one are dropped, found by their keys alone.
    """
    size, bits = wanted_bits(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        held, seen = shared.value, set()
        for ids, texts in pieces(batches, ["doc_id", "text"]):
            classes, sets = [], []
            for i, t in zip(ids, texts):
                words = words_of(text_of(t), lower=True)
                if not words:
                    continue
                cls = class_of(words)
                bit = _bit(cls, i, size)
                if held[bit >> 3] >> (bit & 7) & 1 and cls not in seen:
                    seen.add(cls)
                    classes.append(cls)
                    sets.append(shingle_set(words, width).view("int64"))
            if classes:
                place = pa.array([TaskContext.get().partitionId()] * len(classes), pa.int32())
                yield pa.record_batch([pa.array(classes, pa.binary()), pa.array(sets, pa.list_(pa.int64())), place], ["cls", "shingles", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch(arrow_map(rows, run, "cls binary, shingles array<long>, place int"), "sets")
    twice = found.groupBy("cls").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("cls").alias("of"), "first")
    twice = scratch(twice, "twice")
    if not twice.limit(1).count():
        return found.drop("place")
    return scratch(found.join(twice, (F.col("cls") == F.col("of")) & (F.col("place") != F.col("first")), "left_anti").drop("place"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of cls and centre (of) whose full sets are similar enough.

    A member has a pair for each of its buckets at most, but a centre may have any number: its set is
    laid out in one copy for SHARE members, and each member meets one of the copies.
    """
    centres = pairs.groupBy("of").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies"))
    centres = scratch(centres, "shares").withColumnsRenamed({"of": "of_cls"})
    dealt = pairs.join(centres, F.col("of") == F.col("of_cls")).select("cls", "of", F.pmod(F.xxhash64("cls"), F.col("copies")).cast("int").alias("copy"))
    y = centres.join(sets.select(F.col("cls").alias("of_set"), F.col("shingles").alias("y")), F.col("of_cls") == F.col("of_set"))
    y = y.select(F.col("of_cls").alias("of"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "y")
    x = dealt.join(sets.select("cls", F.col("shingles").alias("x")), "cls")
    j = x.join(y, ["of", "copy"]).select("cls", "of", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    return j.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select(F.least("cls", "of").alias("a"), F.greatest("cls", "of").alias("b"))


def _near_sizes(percent: int):
    return (100 * F.least("n", "of_n") >= percent * F.greatest("n", "of_n")) & (F.col("cls") != F.col("of"))


def classes_linked(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int, percent: int) -> DataFrame:
    """node, label of the linked classes.

    classes: cls, doc_id (its least), n. keys: cls, bands, one row a class.
    """
    each = keys.select("cls", "n", F.explode("bands").alias("bk"))
    shared = scratch(each.groupBy("bk").agg(F.count("*").alias("c")).filter("c > 1"), "buckets")
    # both sides grow with the input: the same plan at every size, never a broadcast
    member = scratch(each.join(shared.hint("merge"), "bk"), "members")
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "node binary, label binary")
    if not member.limit(1).count():
        return nothing
    degree = scratch(member.groupBy("cls").agg(F.sum("c").alias("degree")), "degrees")
    reread = classes.join(degree.select("cls"), "cls", "left_semi")
    sets = full_sets(docs, width, scratch(reread, "wanted"))
    member = scratch(member.drop("c").join(degree, "cls"), "members")
    best = member.groupBy("bk").agg(F.max(F.struct("degree", "cls", "n")).alias("top"))
    centre = scratch(best.select("bk", F.col("top.cls").alias("of"), F.col("top.n").alias("of_n")), "centres")
    met = member.join(centre, "bk")
    # of two that are each other's centres, one is the centre of their pair
    pairs = met.filter(_near_sizes(percent)).groupBy(F.least("cls", "of").alias("a"), F.greatest("cls", "of").alias("b")).agg(F.max("of").alias("of"))
    pairs = scratch(pairs.select(F.when(F.col("of") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("cls"), "of"), "pairs")
    links = scratch(confirmed(pairs, sets, percent), "links")
    label = components(links)
    rest = scratch(across(met.select(F.col("of").alias("hub"), "cls").distinct(), label, sets, percent), "rest")
    return components(links.union(rest)) if rest.limit(1).count() else label


def across(hubs: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between members of one hub that are in different components so far.

    hubs: hub, cls; a hub gathers the members of all buckets of which it is the centre. Of two such
    members one at least is outside the hub's component: those, in blocks of ASIDE, are compared on
    full sets with all members, in blocks of MEMBERS, so that groups are bounded and only links come
    out.
    """
    of = label.select(F.col("node").alias("hub_node"), F.col("label").alias("hub_label"))
    m = hubs.join(label, F.col("cls") == F.col("node"), "left").join(of, F.col("hub") == F.col("hub_node"), "left")
    m = scratch(m.select("hub", "cls", F.coalesce("label", "cls").alias("label"), (F.coalesce("label", "cls") != F.coalesce("hub_label", "hub")).alias("aside")), "hubs")
    mixed = m.groupBy("hub").agg(F.count_if("aside").alias("u"), F.count("*").alias("r")).filter("u > 0")
    mixed = scratch(mixed.select(F.col("hub").alias("in_hub"), F.ceil(F.col("u") / ASIDE).cast("int").alias("us"), F.ceil(F.col("r") / MEMBERS).cast("int").alias("rs"), "u", "r"), "mixed")
    total = mixed.agg(F.sum(F.col("us") * F.col("r") + F.col("rs") * F.col("u"))).first()[0] or 0
    groups = max(1, total // (ASIDE + MEMBERS))
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    m = m.join(mixed, F.col("hub") == F.col("in_hub")).withColumn("mine_u", F.when(F.col("aside"), block("us"))).withColumn("mine_r", block("rs"))
    as_member = F.expr("transform(sequence(0, us - 1), x -> named_struct('ub', x, 'rb', mine_r))")
    as_aside = F.expr("if(aside, transform(sequence(0, rs - 1), x -> named_struct('ub', mine_u, 'rb', x)), array())")
    m = m.join(sets.withColumnRenamed("cls", "of_cls"), F.col("cls") == F.col("of_cls"))
    m = m.select("hub", "cls", "label", "mine_u", "mine_r", "shingles", F.explode(F.array_distinct(F.concat(as_member, as_aside))).alias("cell"))
    m = m.select("hub", "cls", "label", "mine_u", "mine_r", "shingles", "cell.ub", "cell.rb", F.pmod(F.xxhash64("hub", "cell.ub", "cell.rb"), F.lit(groups)).alias("g"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes]] = []
        for (_, ub, rb), cell in rows.groupby(["hub", "ub", "rb"]):
            left, right = cell[cell.mine_u == ub], cell[cell.mine_r == rb]
            if not len(left) or not len(right):
                continue
            both = common_counts(list(left.shingles), list(right.shingles))
            size = left.shingles.map(len).to_numpy()[:, None] + right.shingles.map(len).to_numpy()[None, :]
            near = (100 * both >= percent * (size - both)) & (left.label.to_numpy()[:, None] != right.label.to_numpy()[None, :])
            for i, j in zip(*near.nonzero()):
                out.append(tuple(sorted((left.cls.iloc[i], right.cls.iloc[j]))))
        return pd.DataFrame({"a": [x[0] for x in out], "b": [x[1] for x in out]}, dtype=object)

    return m.groupBy("g").applyInPandas(compare, "a binary, b binary").distinct()


def common_counts(left, right, columns: int = 4096):
    """How many elements each left set shares with each right set (a matrix of integers)."""
    import numpy as np

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    x, xs = flat(left)
    y, ys = flat(right)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for k in range(0, len(shared), columns):
        part = shared[k : k + columns]

        def dense(values, owner, rows):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            m = np.zeros((rows, len(part)), dtype=np.float32)
            m[owner[hit], at[hit]] = 1
            return m

        out += np.rint(dense(x, xs, len(left)) @ dense(y, ys, len(right)).T).astype(np.int64)
    return out


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, cls, n_shingles of every row; and of every class cls, doc_id (its least), label."""
    rows = scratch(sketched(docs, width), "sketches")
    known = rows.filter(F.col("cls").isNotNull())
    classes = scratch(known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n")), "classes")
    keys = known.filter(F.col("bands").isNotNull()).groupBy("cls").agg(F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    label = classes_linked(docs, classes, scratch(keys, "bands"), width, percent)
    labelled = classes.join(label, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
    return rows.drop("bands"), scratch(labelled, "labelled")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    rows, classes = grouped(docs, width, percent)
    least = classes.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("component_id"))
    ids = classes.join(least, F.col("label") == F.col("of")).select(F.col("cls").alias("of_cls"), "component_id")
    out = rows.join(scratch(ids, "ids"), F.col("cls") == F.col("of_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with all its columns; that of the least id, nulls last.

    Of repeated rows, and of rows with a null id, one stays too. Where one id has several texts, each
    is judged by itself. Texts without words belong to no group: one row stays of each id, and all
    rows with a null id.
    """
    rows, classes = grouped(docs, width, percent)
    # nulls come last: a struct of whether it is null, the id, and the class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("first")
    best = scratch(classes.groupBy("label").agg(first).select(F.col("first.cls").alias("_best"), F.col("first.doc_id").alias("_best_id")), "best")
    stays = F.col("cls").isNull() | (F.col("_best").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_best_id")))
    by_id = rows.join(best, F.col("cls") == F.col("_best"), "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    by_id = scratch(by_id.select(F.col("doc_id").alias("_of"), (F.col("n") > 1).alias("many"), "stays"), "verdicts")
    # ids of one row are decided by id alone
    settled = scratch(by_id.filter(F.col("many") | ~F.col("stays")).select("_of"), "settled")  # its own size tells Spark how to join
    once = docs.filter(F.col("doc_id").isNotNull()).join(settled, F.col("doc_id").cast("long") == F.col("_of"), "left_anti")
    again = scratch(by_id.filter(F.col("_of").isNull() | (F.col("many") & F.col("stays"))).select("_of"), "again")
    if not again.limit(1).count():
        return once
    some = docs.join(again, F.col("doc_id").cast("long") == F.col("_of"), "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    some = packed(some, "doc_id", "text")
    some = with_class(some).groupBy("doc_id", "_cls", F.when(F.col("doc_id").isNull() & F.col("_cls").isNull(), F.col("_row")).alias("_none"))
    some = some.agg(F.first("text").alias("text"), F.first("_rest").alias("_rest")).join(best, F.col("_cls") == F.col("_best"), "left")
    some = some.filter(F.col("_cls").isNull() | (F.col("_best").isNotNull() & F.col("doc_id").cast("long").eqNullSafe(F.col("_best_id"))))
    return once.unionByName(unpacked(some, docs, "doc_id", "text"))


def with_class(rows: DataFrame) -> DataFrame:
    """The rows with _cls, their class (null without words), and _row, a number of each row."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            words = [words_of(text_of(t), lower=True) for t in batch.column(at).to_pylist()]
            cls = pa.array([class_of(w) if w else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], cls], names=[*batch.schema.names[:at], "_cls"])

    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*rows.schema.fields]).add("_cls", BinaryType())
    found = arrow_map(rows.withColumn("_text", F.col("text").cast("string")), run, schema)
    return found.withColumn("_row", F.monotonically_increasing_id())
