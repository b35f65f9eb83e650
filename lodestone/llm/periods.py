"""Runs of periodic words, found in tiles of each period octave and stitched together by document and period.

A run is a stretch of consecutive words with smallest period q and a length of max(24, 3 * q) words or
more that no neighbouring word extends. Octaves are the periods below 16, then 16 to 31, 32 to 63, and so
on; an octave has a scale, 8, 16, 32 ..., and boundaries at all multiples of its scale. A boundary's tile
is the scale's words before it and three times as many after it.

In a tile, the Z-function of the words after the boundary tells for every period q how far to the right,
and that of the words before it, read backwards, how far to the left a stretch of period q reaches that
holds the q words after the boundary. Both are cut at one scale. A run of q in the octave shows at two
boundaries at least; at each it reaches one scale or more, both sides together, so that shorter
fragments go. A fragment whose first q words are themselves repetitions of fewer words belongs to a
smaller period and goes. Fragments of neighbouring boundaries share q words at least, and share them
only where they are of one stretch: overlapping ones of a document and a period, put together, are the run.

A tile can only hold a fragment if half a scale of words on one side of the boundary occurs again q words
on; sums of hashed words, which all boundaries compare at once, tell that without losing a tile, and
only those tiles are written. They are dealt over the cluster by document, scale and boundary, so that
a long document is no task's load, and only fragments are gathered by document and period.

Nulls: a null text has no words; the caller says what a null id counts as. Rows are told apart by a key
of the id and the text: repeated rows give repeated results. Other columns are passed by. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .common import arrow_map, pieces

#: Least length of a run, in words and in periods.
WORDS = 24
TIMES = 3
#: Scale of the first octave: WORDS // TIMES, so that each of its periods shows at two boundaries.
FIRST = WORDS // TIMES


def z_function(x: list[int]) -> list[int]:
    """For every place of x, how many elements from there on equal those from its start."""
    n = len(x)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _primes(top: int) -> list[list[int]]:
    """The prime factors of each number up to ``top``."""
    out: list[list[int]] = [[] for _ in range(top + 1)]
    for p in range(2, top + 1):
        if not out[p]:
            for m in range(p, top + 1, p):
                out[m].append(p)
    return out


_factors: list[list[int]] = [[]]


def factors(q: int) -> list[int]:
    """The prime factors of q; from a table that grows by doubling."""
    global _factors
    if q >= len(_factors):
        _factors = _primes(max(q, 2 * len(_factors), 64))
    return _factors[q]


def fragments(before: list[int], after: list[int], scale: int) -> list[tuple[int, int, int]]:
    """(period, words to the left of the boundary, words to its right) of a tile's fragments."""
    right = z_function(after)
    back = before[::-1]
    # the words before the boundary, then all words up to a period on, both backwards
    ahead = after[: 2 * scale - 1]
    left = z_function([*back, -1, *ahead[::-1], *back])
    out = []
    for q in range(1 if scale == FIRST else scale, min(2 * scale, len(after) + 1)):
        r = min(scale, right[q] if q < len(after) else 0)
        lcs = left[len(back) + 1 + len(ahead) - q] if back else 0
        m = min(scale, lcs)
        if m + r >= scale and all(right[q // p] < q - q // p for p in factors(q)):
            out.append((q, m, q + r))
    return out


def prefix_sums(words):
    """Sums of the words' hashes times a power of their place, and the powers. words: the document's, as numbers."""
    import numpy as np

    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(words) + 1, 0x9E3779B97F4A7C15, np.uint64))
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        mixed ^= mixed >> np.uint64(29)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[:-1], dtype=np.uint64)]), power


def hits(sums, power, scale: int):
    """Boundaries of a scale whose tiles may hold a fragment."""
    import numpy as np

    n, gram = len(power) - 1, scale // 2
    at = np.arange(0, n, scale)
    # a gram's code: the difference of two sums, brought to the power of the last gram; equal grams have equal codes
    code = (sums[gram:] - sums[:-gram]) * power[n - gram :: -1]
    last = len(code) - 1
    found = np.zeros(len(at), bool)
    periods = np.arange(1 if scale == FIRST else scale, 2 * scale)
    step = max(1, (1 << 20) // scale)
    for k in range(0, len(at), step):
        for shift in (0, -gram):  # the gram after the boundary, and the one before
            own = at[k : k + step] + shift
            other = own[:, None] + periods
            fits = (own >= 0)[:, None] & (other <= last)
            same = code[np.clip(own, 0, last)][:, None] == code[np.clip(other, 0, last)]
            found[k : k + step] |= (same & fits).any(axis=1)
    return at[found]


def scales(n: int):
    """The scales of a document of n words: their least period fits TIMES times, or WORDS words do."""
    s = FIRST
    while TIMES * s <= n:
        yield s
        s *= 2


def tiled(docs: DataFrame, changed) -> DataFrame:
    """For every document a row with key, doc_id, text (its words joined by spaces, or null without tiles) and plain_sha256
    of those words; for every tile one with key, scale, at, before and after (words as numbers).

    changed(doc_id, words): the words that count, in place of a document's own.
    """

    def run(batches):
        import numpy as np

        rows: list[tuple] = []
        size = 0

        def flush():
            nonlocal rows, size
            types = [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "doc_id", "text", "plain_sha256", "scale", "at", "before", "after"])
            rows, size = [], 0
            return out

        for keys, ids, texts in pieces(batches, ["key", "doc_id", "text"]):
            for key, doc, text in zip(keys, ids, texts):
                # str.split would break at more characters; none of them is in a UTF-8 byte of these six
                words = changed(doc, (text or "").encode("utf-8", "surrogatepass").split())
                joined = b" ".join(words)
                number: dict[bytes, int] = {}
                x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                some = False
                sums, power = prefix_sums(x) if len(x) >= WORDS else (None, None)
                for s in scales(len(x)):
                    for c in hits(sums, power, s).tolist():
                        some = True
                        a, b = x[max(0, c - s) : c].tobytes(), x[c : c + 3 * s].tobytes()
                        rows.append((key, None, None, None, s, c, a, b))
                        size += len(a) + len(b) + 100
                        if size > 8_000_000:
                            yield flush()
                rows.append((key, doc, joined.decode("utf-8", "surrogatepass") if some else None, hashlib.sha256(joined).hexdigest(), None, None, None, None))
                size += (len(joined) if some else 0) + 200
                if size > 8_000_000:
                    yield flush()
        if rows:
            yield flush()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))))
    return arrow_map(d.select(key.alias("key"), "doc_id", "text"), run, "key binary, doc_id long, text string, plain_sha256 string, scale long, at long, before binary, after binary")


def found_fragments(tiles: DataFrame) -> DataFrame:
    """key, period, start, end of every fragment; each tile is solved by itself."""

    def run(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for key, scale, at, before, after in zip(*[c.to_pylist() for c in batch.columns]):
                for q, left, right in fragments(np.frombuffer(before, np.int32).tolist(), np.frombuffer(after, np.int32).tolist(), scale):
                    rows.append((key, q, at - left, at + right))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.binary(), pa.int64(), pa.int64(), pa.int64()])], ["key", "period", "start", "end"])

    return arrow_map(tiles.select("key", "scale", "at", "before", "after"), run, "key binary, period long, start long, end long")


def stitched(pieces_: DataFrame) -> DataFrame:
    """key, start, length, period of every run: fragments of a key and a period that share a period's words are one stretch."""
    by = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("start") <= reached - F.col("period"), 0).otherwise(1)
    runs = pieces_.withColumn("first", first).withColumn("run", F.sum("first").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return runs.select("key", "start", length.alias("length"), "period").filter(length >= F.greatest(F.lit(WORDS), TIMES * F.col("period")))


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of a document's runs (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = None
    for r in runs:  # in the order that ties follow
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    keep, upto = [], 0  # a run's words after its first period go; upto: those before it are decided
    for s, e in sorted((s + q, s + n) for s, n, q in runs):
        keep += words[upto:s] if s > upto else []
        upto = max(upto, e)
    keep += words[upto:]
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest()


def periodic_runs(docs: DataFrame, changed) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli; nulls without one), runs_sha256 and collapsed_sha256."""
    rows = scratch(tiled(docs, changed), "tiles")
    tiles = rows.filter(F.col("scale").isNotNull()).repartition("key", "scale", "at")
    runs = stitched(found_fragments(tiles))
    listed = scratch(runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "runs")
    texts = rows.filter(F.col("scale").isNull()).select("key", "doc_id", "text", "plain_sha256")
    none = hashlib.sha256(b"").hexdigest()
    plain = [F.col("doc_id"), F.lit(0).cast("long").alias("n_runs"), *[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(none).alias("runs_sha256"), F.col("plain_sha256").alias("collapsed_sha256")]

    def run(batches):
        for ids, docs_, found in pieces(batches, ["doc_id", "text", "runs"]):
            out = [(i, *summary(t.encode("utf-8", "surrogatepass").split(), [(r["start"], r["length"], r["period"]) for r in x])) for i, t, x in zip(ids, docs_, found)]
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    joined = texts.filter(F.col("text").isNotNull()).join(listed.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    with_runs = arrow_map(joined.select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<start:long,length:long,period:long>>")).alias("runs")), run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return texts.filter(F.col("text").isNull()).select(*plain).unionByName(with_runs)


def repeated_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by the CRC of its id, with a periodic end: word i from a on becomes word a + (i - a) % p.

    A null id counts as the empty text.
    """
    import zlib

    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
