"""Reports over frames, runs, stances and feature frames: small aggregates, exact percentiles."""

from pyspark.sql import functions as F

from strideforge.functions.frames import cop, total_force, transform
from strideforge.operators.features import unpivoted
from strideforge.operators.quantiles import exact_percentiles
from strideforge.operators.stances import window
from strideforge.schemas import CALIBRATION_CEILING, CHANNELS, LENGTH_MM, T_ON


def _p(c, q):
    return F.percentile(c, F.lit(q))


def timing_report(frames):
    """Frames, duration, sequence gaps and the spread of clock steps per session."""
    w = window(["session_id"], "frame_idx")
    rows = frames.withColumns({"_step": F.col("ts_us") - F.lag("ts_us").over(w), "_d": F.pmod(F.col("seq") - F.lag("seq").over(w), F.lit(65536))})
    return rows.groupBy("session_id").agg(
        F.count("*").alias("n_frames"), ((F.max_by("ts_us", "frame_idx") - F.min_by("ts_us", "frame_idx")) / 1e6).alias("duration_s"),
        F.sum(F.coalesce(F.col("_d") != 1, F.lit(False)).cast("long")).alias("seq_gaps"), F.median("_step").alias("step_median"),
        F.min("_step").alias("step_min"), F.max("_step").alias("step_max"), F.stddev_pop("_step").alias("step_sd"),
        (_p("_step", 0.75) - _p("_step", 0.25)).alias("step_iqr"),
    )


def coverage_report(stances, runs):
    """Per session of merged timed stances: first onset, last end (s), largest gap between kept stances, frames kept and in runs."""
    ends = stances
    gap = (F.col("t0") - F.lag("t1").over(window(["session_id"], "start"))) / 1e6
    kept = ends.withColumn("gap_s", gap).groupBy("session_id").agg(
        (F.min("t0") / 1e6).alias("first_onset_s"), (F.max("t1") / 1e6).alias("last_end_s"), F.max("gap_s").alias("largest_gap_s"), F.sum("n_frames").alias("frames_kept"),
    )
    return kept.join(runs.groupBy("session_id").agg(F.sum("n_frames").alias("frames_natural")), "session_id")


def channel_summary(frames, by=("session_id",), active=100):
    return unpivoted(frames, list(by)).groupBy(*by, "sensor").agg(
        F.min("value").alias("min"), F.median("value").alias("median"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.avg((F.col("value") > active).cast("double")).alias("active_frac"),
    )


def noise_stats(frames, sigmas=5.0):
    """Per session and channel: mean, sample sd, min, max, peak to peak, samples beyond the sigmas (none if sd is 0)."""
    aggs = [F.count("*").alias("n")]
    for c in CHANNELS:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    s = frames.groupBy("session_id").agg(*aggs)
    both = frames.select("session_id", *CHANNELS).join(s.select("session_id", *[f"{k}_{c}" for c in CHANNELS for k in ("mean", "sd")]), "session_id")
    far = lambda c: F.coalesce((F.col(f"sd_{c}") > 0) & (F.abs(F.col(c) - F.col(f"mean_{c}")) > sigmas * F.col(f"sd_{c}")), F.lit(False))
    n_far = both.groupBy("session_id").agg(*[F.sum(far(c).cast("long")).alias(f"far_{c}") for c in CHANNELS])
    each = lambda i, c: F.struct(F.lit(i).alias("sensor"), F.col(f"mean_{c}").alias("mean"), F.col(f"sd_{c}").alias("sd"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"), F.col(f"far_{c}").alias("n_far"))
    rows = s.join(n_far, "session_id").select("session_id", "n", F.explode(F.array(*[each(i, c) for i, c in enumerate(CHANNELS)])).alias("x"))
    return rows.select("session_id", "x.sensor", "n", "x.mean", "x.sd", "x.min", "x.max", (F.col("x.max") - F.col("x.min")).alias("p2p"), "x.n_far")


def ceiling_fraction(frames, ceiling=CALIBRATION_CEILING, by=("session_id",)):
    """Share of frames with each channel, and any, above the ceiling."""
    share = lambda c: F.avg(c.cast("double"))
    return frames.groupBy(*by).agg(*[share(F.col(c) > ceiling).alias(f"above_{c}") for c in CHANNELS], share(F.greatest(*CHANNELS) > ceiling).alias("above_any"))


def zero_fraction(frames, by=("session_id",)):
    return frames.groupBy(*by).agg(*[F.avg((F.col(c) == 0).cast("double")).alias(f"zero_{c}") for c in CHANNELS])


def _with_refined(table, rows, by, value, shares):
    """table with the exact percentiles of very large groups, by the same keys."""
    found = exact_percentiles(rows, by, value, shares)
    same = None
    for c in by:
        here = F.col(f"t.{c}").eqNullSafe(F.col(f"q.{c}"))
        same = here if same is None else same & here
    return table.alias("t").join(found.alias("q"), same, "left").select("t.*", *[f"q.{n}" for n in shares])


def force_distribution(frames, by=("session_id",), t_on=T_ON, refined=False):
    """Least, greatest and percentiles of the total force; refined: percentiles for keys whose counts are too many for one task."""
    t = frames.withColumn("_t", total_force())
    exact = [] if refined else [_p("_t", 0.05).alias("p05"), F.median("_t").alias("median"), _p("_t", 0.95).alias("p95")]
    out = t.groupBy(*by).agg(F.min("_t").alias("min"), F.max("_t").alias("max"), F.avg((F.col("_t") >= t_on).cast("double")).alias("on_frac"), *exact)
    return _with_refined(out, t, by, "_t", {"p05": 0.05, "median": 0.5, "p95": 0.95}) if refined else out


def run_length_report(runs, stances, merged, min_duration, max_duration):
    """Per session: counts of runs, stances and merged stances, run lengths, and runs outside the bounds."""
    n = runs.groupBy("session_id").agg(
        F.count("*").alias("n_runs"), F.min("n_frames").alias("min"), F.median("n_frames").alias("median"), _p("n_frames", 0.9).alias("p90"),
        F.max("n_frames").alias("max"), F.sum((F.col("n_frames") > max_duration).cast("long")).alias("n_over"),
        F.sum((F.col("n_frames") < min_duration).cast("long")).alias("n_under"),
    )
    for name, t in (("n_stances", stances), ("n_merged", merged)):
        n = n.join(t.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left").fillna(0, [name])
    return n


def dt_drift(stances, dt):
    """Per session of merged timed stances the one whose length at a uniform step differs most from the clock: drift_s, and the longest."""
    e = stances.join(dt, "session_id")
    d = e.withColumn("drift_s", (F.col("end") - F.col("start")) * F.col("dt_s") - (F.col("t1") - F.col("t0")) / 1e6)
    return d.groupBy("session_id").agg(F.max("n_frames").alias("longest"), F.max(F.abs("drift_s")).alias("worst_drift_s"))


def describe_features(rows, features, by="label", refined=False):
    """n, mean, sd, min, median and max per class and feature; refined: medians for classes whose values are too many for one task."""
    long = rows.select(by, F.expr("stack(%d, %s) as (feature, value)" % (len(features), ", ".join(f"'{f}', cast({f} as double)" for f in features))))
    exact = [] if refined else [F.median("value").alias("median")]
    out = long.groupBy(by, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), *exact,
    )
    return _with_refined(out, long, [by, "feature"], "value", {"median": 0.5}) if refined else out


def feature_histogram(rows, feature, bins=20, by="label"):
    """Counts per class in equal bins over all classes; the right edge is in the last bin."""
    edge = rows.agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    b = F.least(F.floor((F.col(feature) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    binned = rows.filter(F.col(feature).isNotNull()).join(F.broadcast(edge)).withColumn("bin", F.coalesce(b, F.lit(0)).cast("int"))  # edge: one row
    return binned.groupBy(by, "bin").count()


def population_diff(a, b, metrics, by="label"):
    """Means and sample deviations of two populations per class and metric, difference and percentage."""
    da, db = (describe_features(x, metrics, by).select(by, "feature", F.col("mean").alias(f"mean_{n}"), F.col("sd").alias(f"sd_{n}")) for x, n in ((a, "a"), (b, "b")))
    d = da.join(db, [by, "feature"], "full")
    return d.withColumn("delta", F.col("mean_b") - F.col("mean_a")).withColumn("pct", F.try_divide(100 * F.col("delta"), F.col("mean_a")))


def session_shift(rows, feature):
    """Per class and session: n, mean, sd, and its distance from the class's other sessions in deviations of the class."""
    s = rows.groupBy("label", "session").agg(F.count(feature).alias("n"), F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("sd"), F.sum(feature).alias("_s"))
    c = rows.groupBy("label").agg(F.count(feature).alias("_n"), F.sum(feature).alias("_t"), F.stddev_samp(feature).alias("_sd"))
    j = s.join(F.broadcast(c), "label")  # one row a class
    other = F.try_divide(F.col("_t") - F.col("_s"), F.col("_n") - F.col("n"))
    return j.withColumn("shift", F.try_divide(F.col("mean") - other, F.col("_sd"))).select("label", "session", "n", "mean", "sd", "shift")


def ml_spread(inside, whole=True):
    """Spread over stances of the mean medial-lateral centre of pressure, in mm: sample sd and range per label."""
    rows = inside if whole else inside.filter("frame_idx < end")
    per = rows.groupBy("label", "session_id", "stance").agg((F.avg("cop_x") * LENGTH_MM).alias("ml"))
    return per.groupBy("label").agg(F.stddev_samp("ml").alias("sd_mm"), (F.max("ml") - F.min("ml")).alias("range_mm"), F.count("ml").alias("n"))


def band_overlap(rows, feature, accuracy=None, refined=False):
    """Share of class a inside class b's 10 to 90 % band, for all a, b that differ; accuracy: of approximate percentiles.

    refined: exact percentiles of classes whose values are too many for one task.
    """
    at = (lambda q: F.percentile_approx(feature, q, accuracy)) if accuracy else (lambda q: _p(feature, q))
    band = rows.groupBy(F.col("label").alias("b")).agg(at(0.1).alias("_lo"), at(0.9).alias("_hi")) if not refined else exact_percentiles(rows.withColumn("b", F.col("label")), ["b"], feature, {"_lo": 0.1, "_hi": 0.9})
    j = rows.filter(F.col(feature).isNotNull()).join(F.broadcast(band), F.col("label") != F.col("b"))  # one row a class
    return j.groupBy(F.col("label").alias("a"), "b").agg(F.avg(F.col(feature).between(F.col("_lo"), F.col("_hi")).cast("double")).alias("share"))


def peak_trend(rows, y="peak_counts", x="onset_s"):
    """Line of y on x per class and per class and session: slope, intercept, r, n and the two-sided p of the slope."""
    import pandas as pd

    from strideforge.functions.tails import t_two_sided

    trend = (
        rows.groupingSets([["label"], ["label", "session"]], "label", "session")
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.regr_count(y, x).alias("n"))
    )

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(r, n)], dtype="float64")

    return trend.withColumn("p", p_value("r", "n"))


def zero_channel_effect(frames, by=("session_id",), sensor="s4", pooled=False, accuracy=None):
    """Shift of the centre of pressure (mm) when zeros of the sensor are replaced by its median non-zero count, on loaded frames.

    An exact median keeps the counts of its key; accuracy asks for Spark's approximate one, for keys of a whole fleet.
    """
    nonzero = F.when(F.col(sensor) > 0, F.col(sensor))
    median = F.percentile_approx(nonzero, 0.5, accuracy) if accuracy else F.median(nonzero)
    if pooled:
        rows = frames.join(F.broadcast(frames.agg(median.alias("_m"))))  # one row
    else:  # a row a key; Spark broadcasts it where it is small
        rows = frames.join(frames.groupBy(*by).agg(median.alias("_m")), list(by))
    hit = rows.filter((F.col(sensor) == 0) & (total_force() > 0) & F.col("_m").isNotNull())
    a = cop(hit, names=("_x", "_y"))
    renamed = a.withColumns({f"_{c}": F.col(c) for c in CHANNELS}).withColumn(f"_{sensor}", F.col("_m"))
    b = cop(renamed, [f"_{c}" for c in CHANNELS], ("_x2", "_y2"))
    dx, dy = (F.col("_x2") - F.col("_x")) * LENGTH_MM, (F.col("_y2") - F.col("_y")) * LENGTH_MM
    return b.groupBy(*by).agg(F.count("*").alias("n"), F.avg(dx).alias("dx_mm"), F.avg(dy).alias("dy_mm"), F.avg(F.hypot(dx, dy)).alias("dist_mm"))


def representation_shift(frames, a="raw", b="gain_matched", gains=None, by=("session_id",), accuracy=None):
    """Mean and median distance (mm) between the centres of pressure of two representations, frames without one left out.

    accuracy asks for Spark's approximate median, for keys of a whole fleet.
    """
    raw = frames.withColumns({f"_k{c}": F.col(c) for c in CHANNELS})
    one = cop(transform(raw, a, gains), names=("_xa", "_ya")).withColumns({c: F.col(f"_k{c}") for c in CHANNELS})
    two = cop(transform(one, b, gains), names=("_xb", "_yb"))
    d = F.hypot(F.col("_xb") - F.col("_xa"), F.col("_yb") - F.col("_ya")) * LENGTH_MM
    return two.withColumn("_d", d).filter("_d is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_mm"), (F.percentile_approx("_d", 0.5, accuracy) if accuracy else F.median("_d")).alias("median_mm"))


def majority(rows, label="label"):
    """Class counts, and the most common class (ties to the first name) with its share."""
    counts = rows.groupBy(label).count()
    top = counts.agg(F.max(F.struct("count", label)).alias("t"), F.sum("count").alias("n"))
    return top.select(F.col("t.count").alias("n_top"), (F.col("t.count") / F.col("n")).alias("floor"), "n")


def majority_floor(train, test, label="label"):
    """Floors that a classifier is read against: most common class of all rows, of the test rows, and that of train on test.

    One row: floor_all, floor_test, train_top (ties to the first name), train_on_test (its share of the test rows), n_test.
    """
    n = train.groupBy(label).agg(F.count("*").alias("a")).join(test.groupBy(label).agg(F.count("*").alias("b")), label, "full").fillna(0, ["a", "b"])
    top = n.agg(F.min(F.struct((-F.col("a")).alias("k"), F.col(label).alias("c"), "b")).alias("t"), F.max(F.col("a") + F.col("b")).alias("m"), F.sum(F.col("a") + F.col("b")).alias("n"), F.max("b").alias("mb"), F.sum("b").alias("nb"))
    return top.select(
        F.try_divide("m", "n").alias("floor_all"), F.try_divide("mb", "nb").alias("floor_test"), F.col("t.c").alias("train_top"),
        F.try_divide(F.col("t.b"), F.col("nb")).alias("train_on_test"), F.col("nb").alias("n_test"),
    )


def prediction_summary(predicted):
    return predicted.groupBy("pred").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("agreement"))
