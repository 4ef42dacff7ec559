"""Bench calibration: steady windows, trial statistics, line fits per sensor, matched gains."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.schemas import FLAT_RANGE, FORCE_RANGE, FULL_SCALE, MIN_POINTS, MIN_R2, MIN_STEADY, REST_MIN, SATURATION_MARGIN, SETTLE_S


def with_rest_min(manifest, by="sensor", at="timestamp_iso"):
    """Minutes since the same sensor's previous trial; null for its first."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    gap = t - F.lag(t).over(Window.partitionBy(by).orderBy(at))
    return manifest.withColumn("rest_min", gap / 6e7)


def steady_median(frames, value="value", by=("session_id",), settle_s=SETTLE_S, min_steady=MIN_STEADY):
    """Median of a capture after its first settle_s seconds; of all samples if fewer than min_steady remain.

    Time is ts_us; where a capture has none, the row number at 100 Hz.
    """
    w = Window.partitionBy(*by)
    t = F.coalesce((F.col("ts_us") - F.min("ts_us").over(w)) / 1e6, (F.row_number().over(w.orderBy("frame_idx")) - 1) / 100.0)
    rows = frames.withColumn("_v", F.when(t >= settle_s, F.col(value)))
    return rows.groupBy(*by).agg(
        F.when(F.count("_v") >= min_steady, F.median("_v")).otherwise(F.median(value)).alias("steady"), F.count("_v").alias("n_steady")
    )


def trial_stats(rows, value="value", by=("sensor", "trial"), full_scale=FULL_SCALE, wide=200.0):
    """n, mean, sample sd (0 for one sample), min, max, saturated count and share, and whether the spread is wide."""
    sat = (F.col(value) == full_scale).cast("long")
    sd = F.when(F.count(value) < 2, 0.0).otherwise(F.stddev_samp(value))
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.sum(sat).alias("n_saturated"), F.avg(sat).alias("saturated_frac"), (sd > wide).alias("wide"),
    )


def fit_sensors(points, sensors=range(6), full_scale=FULL_SCALE, margin=SATURATION_MARGIN, flat=FLAT_RANGE, min_r2=MIN_R2, min_points=MIN_POINTS):
    """Line force = a x + b over conductance x per sensor of points(sensor, count, force_n), with its flag.

    Saturated points and points without a conductance are counted and left out. The flag is, in this order, no_data,
    few_points, flat (range of counts), degenerate (no spread), poor_fit, ok; r2 is null where the force does not vary.
    """
    spark = points.sparkSession
    c = F.col("count").cast("double")
    sat = c >= full_scale - margin
    x = F.when(~sat & (c > 0) & (c < full_scale), c / (full_scale - c))
    rows = points.withColumns({"_sat": sat, "_x": x})
    used = lambda v: F.when(F.col("_x").isNotNull(), v)
    y, xx = used(F.col("force_n")), F.when(F.col("force_n").isNotNull(), F.col("_x"))
    fits = rows.groupBy("sensor").agg(
        F.regr_slope(y, xx).alias("a"), F.regr_intercept(y, xx).alias("b"), F.regr_r2(y, xx).alias("r2"), F.var_pop(y).alias("_vy"),
        F.var_pop(xx).alias("_vx"), F.count("_x").alias("n_points"), F.sum(F.col("_sat").cast("long")).alias("n_saturated"),
        F.sum((~F.col("_sat") & F.col("_x").isNull()).cast("long")).alias("n_dropped"), F.min("_x").alias("x_min"), F.max("_x").alias("x_max"),
        (F.max(used(c)) - F.min(used(c))).alias("count_range"),
    )
    flag = (
        F.when(F.col("n_points").isNull(), "no_data").when(F.col("n_points") < min_points, "few_points").when(F.col("count_range") < flat, "flat")
        .when((F.col("_vx") == 0) | F.col("a").isNull(), "degenerate").when(F.coalesce(F.col("r2"), F.lit(0.0)) < min_r2, "poor_fit").otherwise("ok")
    )
    every = spark.createDataFrame([(int(s),) for s in sensors], "sensor int")
    joined = every.join(fits, "sensor", "left").withColumn("r2", F.when(F.col("_vy") > 0, F.col("r2")))
    return joined.withColumn("flag", flag).drop("_vy", "_vx").fillna(0, ["n_points", "n_saturated", "n_dropped"])


def residuals(points, fits, full_scale=FULL_SCALE):
    """Per sensor the residuals of its points in the order of the counts."""
    c = F.col("count").cast("double")
    x = F.when((c > 0) & (c < full_scale - SATURATION_MARGIN), c / (full_scale - c))
    r = points.withColumn("_x", x).filter("_x is not null").join(F.broadcast(fits.select("sensor", "a", "b")), "sensor")  # one row a sensor
    r = r.withColumn("r", F.col("force_n") - (F.col("a") * F.col("_x") + F.col("b")))
    return r.groupBy("sensor").agg(F.transform(F.sort_array(F.collect_list(F.struct("_x", "r"))), lambda s: s["r"]).alias("residuals"))


def select_matched_cycle(manifest, rest_min=REST_MIN, force_range=FORCE_RANGE):
    """Trials after a rest of rest_min minutes with a force in the range; an error unless there is exactly one per sensor 0..5."""
    low, high = force_range
    chosen = with_rest_min(manifest).filter((F.col("rest_min") >= rest_min) & F.col("force_n").between(low, high))
    counts = {r["sensor"]: r["n"] for r in chosen.groupBy("sensor").agg(F.count("*").alias("n")).collect()}  # a row a sensor
    wrong = [f"sensor {s}: {counts.get(s, 0)} trials" for s in range(6) if counts.get(s, 0) != 1]
    if wrong:
        raise ValueError("no matched cycle: " + ", ".join(wrong))
    return chosen


def derive_gain_match(chosen, count="count_mean", full_scale=FULL_SCALE):
    """k = force / conductance and correction = k / mean k of a matched cycle's six trials."""
    c = F.col(count)
    k = chosen.withColumn("k", F.col("force_n") / (c / (full_scale - c)))
    mean = k.agg(F.avg("k").alias("_m"))
    return k.join(F.broadcast(mean)).withColumn("correction", F.col("k") / F.col("_m")).select("sensor", "k", "correction")  # mean: one row


def calibration_ceiling(frames, channels=("s0", "s1", "s2", "s3", "s4", "s5")):
    """Highest raw count of any channel."""
    return frames.agg(F.max(F.greatest(*channels)).alias("ceiling"))
