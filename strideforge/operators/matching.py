"""Comparisons: detections with truth, captures with captures, counts with pins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.schemas import CHANNELS


def match_intervals(detected, truth, least_share=0.0):
    """Greedy one-to-one matches of detections, in order, to truth intervals of the same session.

    A detection takes the unclaimed truth interval that it overlaps most (ties to the earlier one); with least_share, only
    one of which it covers that share. Sessions' intervals are few; they are matched by a grouped helper on stances, never
    on frames. Returns session_id, start, end, t_start, t_end.
    """
    both = detected.select("session_id", "start", "end", F.lit(0).alias("side")).unionByName(truth.select("session_id", "start", "end", F.lit(1).alias("side")))

    def claim(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["start", "end"])
        free = list(pdf[pdf.side == 1][["start", "end"]].itertuples(index=False, name=None))
        out, lo = [], 0
        for a, b in pdf[pdf.side == 0][["start", "end"]].itertuples(index=False, name=None):
            while lo < len(free) and (free[lo] is None or free[lo][1] < a):
                lo += 1
            best, at = 0, None
            for i in range(lo, len(free)):
                if free[i] is None:
                    continue
                s, e = free[i]
                if s > b:
                    break
                n = min(b, e) - max(a, s) + 1
                if n > best and n >= least_share * (e - s + 1):
                    best, at = n, i
            if at is not None:
                out.append((pdf.session_id.iloc[0], a, b, *free[at]))
                free[at] = None
        return pd.DataFrame(out, columns=["session_id", "start", "end", "t_start", "t_end"])

    key = both.schema["session_id"].dataType.simpleString()
    return both.groupBy("session_id").applyInPandas(claim, f"session_id {key}, start long, end long, t_start long, t_end long")


def boundary_report(detected, truth):
    """Per session of the matches: n, mean offsets of start and end, mean error of the duration (frames)."""
    m = match_intervals(detected, truth)
    ds, de = F.col("start") - F.col("t_start"), F.col("end") - F.col("t_end")
    return m.groupBy("session_id").agg(F.count("*").alias("n_matched"), F.avg(ds).alias("start_offset"), F.avg(de).alias("end_offset"), F.avg(de - ds).alias("duration_error"))


def scorecard(detected, truth, least_share=0.5):
    """Per session: true and false positives, misses, precision, recall and F1 (all null where both sides are empty)."""
    n = lambda t, name: t.groupBy("session_id").agg(F.count("*").alias(name))
    s = n(detected, "n_det").join(n(truth, "n_true"), "session_id", "full").join(n(match_intervals(detected, truth, least_share), "tp"), "session_id", "left")
    s = s.fillna(0, ["n_det", "n_true", "tp"])
    return s.select(
        "session_id", "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"),
        F.try_divide(F.col("tp"), F.col("n_det")).alias("precision"), F.try_divide(F.col("tp"), F.col("n_true")).alias("recall"),
        F.try_divide(2 * F.col("tp"), F.col("n_det") + F.col("n_true")).alias("f1"),
    )


def compare_captures(a, b, key=("session_id", "seq")):
    """Per session: rows of both captures, frames in both, mismatches per column, coverage of a in per cent."""
    key = list(key)
    cols = ["ts_us", *CHANNELS]
    j = a.select(*key, *cols).join(b.select(*key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(1).alias("_there")), key, "left")
    out = j.groupBy("session_id").agg(
        F.count("*").alias("n_a"), F.count("_there").alias("n_both"),
        *[F.sum((F.col("_there").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("long")).alias(f"diff_{c}") for c in cols],
    )
    out = out.join(b.groupBy("session_id").agg(F.count("*").alias("n_b")), "session_id", "left").fillna(0, ["n_b"])
    return out.withColumn("coverage_pct", 100.0 * F.col("n_both") / F.col("n_a"))


def comparison_verdict(compared):
    """compare_captures with verdict: no_overlap (a refusal: the captures share no frame), mismatch, or same."""
    differ = sum((F.col(f"diff_{c}") for c in ["ts_us", *CHANNELS]), F.lit(0))
    return compared.withColumn("verdict", F.when(F.col("n_both") == 0, "no_overlap").when(differ > 0, "mismatch").otherwise("same"))


def first_mismatches(a, b, key=("session_id", "seq"), limit=10):
    """Per session the first frames of both captures that differ, in the order of the key: both sides' values."""
    key = list(key)
    cols = ["ts_us", *CHANNELS]
    j = a.select(*key, *cols).join(b.select(*key, *[F.col(c).alias(f"{c}_b") for c in cols]), key)
    differ = F.lit(False)
    for c in cols:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"{c}_b"))
    w = Window.partitionBy("session_id").orderBy(*[k for k in key if k != "session_id"])
    return j.filter(differ).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def pinned_counts(counts, pins):
    """Sessions whose stance count differs from its pin, and sessions without one."""
    j = counts.join(pins, "session_id", "left")
    state = F.when(F.col("pinned").isNull(), "no_pin").when(F.col("pinned") != F.col("n_stances"), "mismatch")
    return j.withColumn("state", state).filter("state is not null")


def known_classes(rows, classes):
    """Rows whose label the model knows; classes: a small table with a column label."""
    return rows.join(classes.select("label"), "label", "left_semi")
