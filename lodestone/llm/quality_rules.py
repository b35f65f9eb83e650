"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Every document is measured once. The measures (integers, per ten thousand) of the documents that
pass the base rules go into log-linear histograms per language and source: values up to 255 have
bins of their own, larger ones share bins of a 128th of their size. Such sketches merge by adding
counts, exactly and in any order, and their quantiles are at most 1/128 too low. A document passes
if all its measures lie within the thresholds of its group: its median, moved outwards by SPREAD times
the distance to the lower quartile. Junk that raises a measure moves neither before it is half of the
group; there is no other constant. Where the lower quartile is the median, the group shows no spread
and the measure has no threshold there. A group's sketch is merged with its language's, weighed as PRIOR
documents, and the language's with that of all documents, weighed likewise: with every document of its own a group
moves away from them, at every size.

The measures are ones that vary among clean documents too, so that quartiles tell how much: marks
(ASCII characters other than letters, digits and blanks), capitals, words equal to the one before, and
the length of words.

Nulls: a null text has no words (and fails); a null language or source is a group of its own. An
empty text counts likewise. Repeated rows are measured and returned each. Other columns are
passed by. An empty table gives an empty result.
"""

from __future__ import annotations

from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch
from .common import arrow_map, text_of, words_of

#: Documents that the sketch above counts as in a merge, and units that a document counts as there.
PRIOR, UNITS = 100, 1_000_000
SPREAD = 20
#: Leading binary digits of a value that its bin keeps.
DIGITS = 8
#: Measure: (numerator, denominator, whether low values fail too).
MEASURES = {
    "marks": ("n_marks", "word_chars", False),
    "capitals": ("n_capitals", "word_chars", False),
    "stutters": ("n_stutters", "n_words", False),
    "word_length": ("word_chars", "n_words", True),
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_stutters"]


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words found at least twice, the first included."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(0xBF58476D1CE4E5B9)
    ids ^= ids >> np.uint64(32)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        total = total * np.uint64(0x100000001B3 * 2 + 1) + ids[j : j + n]
        total ^= total >> np.uint64(31)
    order = np.sort(total)
    same = order[1:][order[1:] == order[:-1]]
    if not len(same):
        return 0
    starts = np.flatnonzero(np.isin(total, same))
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure_text(text: str) -> tuple[int, ...]:
    """The counts of _COUNTS for one text."""
    import numpy as np

    words = words_of(text)
    by_byte = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    blanks = int(by_byte[9:14].sum() + by_byte[32])
    seen: set[str] = set()
    copies = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            copies += line in seen
            seen.add(line)
    symbols = int(sum(by_byte[b] for b in b"#*$%&|<>"))
    capitals = int(by_byte[65:91].sum())
    marks = int(by_byte[:128].sum()) - blanks - capitals - int(by_byte[97:123].sum() + by_byte[48:58].sum())
    return len(words), len(text) - blanks, symbols, copies, repeated_words(words), marks, capitals, sum(map(eq, words, words[1:]))


def measured(rows: DataFrame) -> DataFrame:
    """The rows, their column text replaced by the counts of every whole text."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = list(zip(*(measure_text(text_of(t.as_py())) for t in batch.column(at))))
            counts = [pa.array(c, pa.int64()) for c in found or [[]] * len(_COUNTS)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *counts], names=[*(batch.schema.names[i] for i in rest), *_COUNTS])

    schema = StructType([f for f in rows.schema.fields if f.name != "text"])
    for c in _COUNTS:
        schema = schema.add(c, "long")
    return arrow_map(rows, run, schema)


def ratio(name: str):
    """A measure per ten thousand; 0 where there is nothing to divide by."""
    top, bottom, _ = MEASURES[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {top} * 10000 DIV {bottom} ELSE 0L END")


def bin_of(value):
    """The lowest value of the sketch's bin that holds ``value``."""
    drop = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(judged: DataFrame) -> DataFrame:
    """Histograms of the documents that pass the base rules: lang, source, measure, bin, n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(ratio(m)).alias("bin")) for m in MEASURES]))
    good = judged.filter(~F.col("base_failed")).select("lang", "source", each.alias("x"))
    return good.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merged(hist: DataFrame) -> DataFrame:
    """The groups' sketches merged with those above: lang, source, measure, bin, w (whole units).

    A sketch has some thousand bins at most, whatever it counts.
    """
    level = lambda *keys: hist.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    whole, lang = level(), level("lang")
    share = F.expr(f"n * {UNITS} DIV total")
    whole = whole.withColumn("total", F.sum("n").over(Window.partitionBy("measure"))).select(F.col("measure").alias("m"), "bin", share.alias("share"))
    total = lang.groupBy("lang", "measure").agg((F.sum("n") + PRIOR).alias("total"))
    above = total.select("lang", "measure").join(whole, F.col("measure") == F.col("m")).select("lang", "measure", "bin", (PRIOR * F.col("share")).alias("w"))
    lang = lang.select("lang", "measure", "bin", (F.col("n") * UNITS).alias("w")).unionByName(above).groupBy("lang", "measure", "bin").agg(F.sum("w").alias("w"))
    total = total.select(F.col("lang").alias("t_lang"), F.col("measure").alias("t_measure"), "total")
    lang = lang.join(total, F.col("lang").eqNullSafe(F.col("t_lang")) & (F.col("measure") == F.col("t_measure")))
    lang = lang.select(F.col("lang").alias("of_lang"), F.col("measure").alias("of_measure"), "bin", F.expr(f"{PRIOR} * w DIV total").alias("w"))
    groups = hist.select("lang", "source", "measure").distinct()
    more = groups.join(lang, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of_measure"))).select("lang", "source", "measure", "bin", "w")
    own = hist.select("lang", "source", "measure", "bin", (F.col("n") * UNITS).alias("w"))
    return own.unionByName(more).groupBy("lang", "source", "measure", "bin").agg(F.sum("w").alias("w"))


def quartiles(sketch: DataFrame) -> DataFrame:
    """Per group and measure: lower quartile q1 and median q2."""
    w = Window.partitionBy("lang", "source", "measure")
    upto = sketch.select("lang", "source", "measure", "bin", F.sum("w").over(w.orderBy("bin")).alias("upto"), F.sum("w").over(w).alias("total"))
    return upto.groupBy("lang", "source", "measure").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bin"))).alias("q2"),
    )


def fences(hist: DataFrame) -> DataFrame:
    """One row per language and source with <measure>_low and <measure>_high."""
    j = quartiles(merged(hist))
    out = []
    for m, (_, _, both) in MEASURES.items():
        spread = SPREAD * (F.col("q2") - F.col("q1"))
        mine = (F.col("measure") == m) & (spread > 0)
        out.append(F.max(F.when(mine, F.col("q2") + spread)).alias(f"{m}_high"))
        if both:
            out.append(F.max(F.when(mine, F.col("q2") - spread)).alias(f"{m}_low"))
    return j.groupBy("lang", "source").agg(*out)


def within(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with kept: whether they pass the base rules and lie within the limits of their group."""
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    j = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    fine = ~F.col("base_failed")
    for m, (_, _, both) in MEASURES.items():
        fine &= F.coalesce(ratio(m) <= F.col(f"{m}_high"), F.lit(True))
        if both:
            fine &= F.coalesce(ratio(m) >= F.col(f"{m}_low"), F.lit(True))
    return j.select(*[F.col(f"`{c}`") for c in rows.columns], fine.alias("kept"))


_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's id, language, source, counts and base_failed as a written table; and the limits by group."""
    kinds = {"doc_id": "long", "lang": "string", "source": "string", "text": "string"}
    rows = measured(docs.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])).withColumn("base_failed", F.expr(_FAILED))
    rows = scratch(rows, "quality")
    return rows, fences(sketches(rows))


def judge(docs: DataFrame) -> DataFrame:
    """Every document's counts, whether the base rules fail it, and whether it is kept."""
    return within(*judged(docs)).select("doc_id", "lang", "source", *_COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns. Each row is judged by itself, whatever its id is."""
    _, limits = judged(docs)
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("whole")
    rows = docs.select(whole, *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    kept = within(measured(rows).withColumn("base_failed", F.expr(_FAILED)), scratch(limits, "limits")).filter("kept")
    return kept.select("whole.*")
