"""What to read again: each source's reviews folded into an interval, and the queue of what is due.

A review has a grade from 0 to 5. Below 3 the source was forgotten: it comes again after a day. From 3 on
the interval is 1 day, then 6, then the last one times the ease, which grows with good grades and
shrinks with poor ones. All in whole numbers: ease in thousandths, intervals in days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ease at first and at least, in thousandths; days at most.
EASE, LEAST_EASE, MOST_DAYS = 2500, 1300, 36500


def _step(s: Column, r: Column) -> Column:
    """The state after a review."""
    short = 5 - r["grade"]
    good = r["grade"] >= 3
    ease = F.greatest(F.lit(LEAST_EASE).cast("long"), s["ease"] + 100 - short * (80 + short * 20))
    reps = F.when(good, s["reps"] + 1).otherwise(F.lit(0).cast("long"))
    days = F.when(~good | (reps == 1), F.lit(1).cast("long")).when(reps == 2, F.lit(6).cast("long")).otherwise(F.floor((s["days"] * s["ease"] + 500) / 1000).cast("long"))
    lapses = s["lapses"] + F.when(good, 0).otherwise(1)
    return F.struct(ease.alias("ease"), reps.alias("reps"), F.least(days, F.lit(MOST_DAYS).cast("long")).alias("days"), lapses.cast("long").alias("lapses"))


def folded(reviews: DataFrame) -> DataFrame:
    """source_id, n_reviews, lapses, ease, days, due_at of every reviewed source. reviews: source_id, at (timestamp), seq, grade.

    In the order of at, then seq. Grades outside 0 to 5 count as the nearest; reviews with a null are left out. A
    source's history is one row: it grows with what its reader does.
    """
    r = reviews.withColumn("at", F.col("at").cast("timestamp")).dropna(subset=["source_id", "at", "seq", "grade"])
    grade = F.least(F.greatest(F.col("grade"), F.lit(0)), F.lit(5)).cast("long").alias("grade")
    g = r.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", grade))).alias("h"), F.max("at").alias("last"))
    zero = F.struct(F.lit(EASE).cast("long").alias("ease"), *[F.lit(0).cast("long").alias(c) for c in ("reps", "days", "lapses")])
    g = g.withColumn("s", F.aggregate("h", zero, _step))
    due = F.timestamp_micros(F.unix_micros("last") + F.col("s.days") * 86_400_000_000)
    return g.select("source_id", F.size("h").cast("long").alias("n_reviews"), "s.lapses", "s.ease", "s.days", due.alias("due_at"))


def queue(history: DataFrame, sources: DataFrame, knowledge: DataFrame, now: Column) -> DataFrame:
    """source_id, recheck, open_questions, due_at, overdue_days of what should be read again, in that order: marked for recheck, then by open questions, then by how long due.

    history: folded(). A source that is neither due nor marked nor has an open question isn't listed.
    """
    q = knowledge.filter("info_type = 'open_question'").groupBy(F.col("source_id").alias("_q")).agg(F.count("*").alias("open"))
    h = history.select(F.col("source_id").alias("_h"), "due_at")
    s = sources.select(F.col("id").alias("source_id"), F.coalesce(F.col("reading_status") == "recheck", F.lit(False)).alias("recheck"))
    j = s.join(q, F.col("source_id") == F.col("_q"), "left").join(h, F.col("source_id") == F.col("_h"), "left")
    late = F.floor((F.unix_micros(now) - F.unix_micros("due_at")) / 86_400_000_000).cast("long")
    j = j.select("source_id", "recheck", F.coalesce("open", F.lit(0)).alias("open_questions"), "due_at", F.when(F.col("due_at") <= now, late).alias("overdue_days"))
    j = j.filter("recheck OR open_questions > 0 OR overdue_days IS NOT NULL")
    return j.orderBy(F.desc("recheck"), F.desc("open_questions"), F.desc_nulls_last("overdue_days"), "source_id")
