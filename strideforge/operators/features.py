"""Features of stances: force, centre-of-pressure path, context, per-sensor metrics and activation order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.functions.frames import cop, frame_flags, total_force, transform
from strideforge.operators.stances import before, frames_in_intervals, frames_in_stances, window
from strideforge.schemas import CHANNELS, COP_FEATURES, FORCE_FEATURES

KEY = ["session_id", "stance"]


def stance_frames(frames, rep="raw", gains=None, by=("session_id",), stances=None, **detector):
    """Frames of merged stances with dt_s and the load of the representation: detection is on raw counts, the rest is not.

    With stances (keys, start, end, and stance or none) those are taken as they are, overlapping ones too, and nothing is detected. Adds total (raw), load and cop_x, cop_y of the representation; one exchange, on session_id.
    """
    by = list(by)
    step = F.col("ts_us") - F.lag("ts_us").over(window(by, "frame_idx"))
    rows = frames.withColumn("total", total_force()).withColumn("_step", step)
    rows = rows.withColumn("dt_s", F.median("_step").over(Window.partitionBy(*by)) / 1e6).drop("_step")
    inside = frames_in_stances(rows, by=by, **detector) if stances is None else frames_in_intervals(rows, stances, by)
    return represented(inside, rep, gains)


def represented(inside, rep="raw", gains=None):
    """Frames inside stances with load, cop_x and cop_y of a representation, whatever the one that they carry."""
    raw = {f"_raw_{c}": F.col(c) for c in CHANNELS}
    there = cop(transform(inside.withColumns(raw), rep, gains)).withColumn("load", total_force())
    return there.withColumns({c: F.col(f"_raw_{c}") for c in CHANNELS}).drop(*raw)


def _first_peak(value="load"):
    return F.max(F.struct(F.col(value).alias("v"), (-F.col("frame_idx")).alias("i")))


def stance_features(inside, by=("session_id",), also=()):
    """Seven features and context per stance of stance_frames: features leave the last frame out, s4_zero_frac does not.

    also: further aggregates over all frames of a stance, by name; they follow as columns.
    """
    also = dict(also)
    key = [*by, "stance"]
    open_ = F.col("frame_idx") < F.col("end")
    point = F.when(open_ & F.col("cop_x").isNotNull(), F.struct("cop_x", "cop_y"))
    rows = inside.withColumn("_p", point)
    last = F.last("_p", ignorenulls=True).over(before(window(key, "frame_idx")))
    rows = rows.withColumn("_q", last).withColumn("_d", F.hypot(F.col("_p.cop_x") - F.col("_q.cop_x"), F.col("_p.cop_y") - F.col("_q.cop_y")))
    load = F.when(open_, F.col("load"))
    found = rows.groupBy(*key).agg(
        F.first("start").alias("start"),
        F.first("end").alias("end"),
        F.first("dt_s").alias("dt_s"),
        F.max(F.when(open_, F.struct(F.col("load").alias("v"), (-F.col("frame_idx")).alias("i")))).alias("_peak"),
        F.sum(load).alias("_sum"),
        F.min_by("load", "frame_idx").alias("_first"),
        F.sum("_d").alias("_path"),
        F.count("_p").alias("_n"),
        F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("frame_idx"))).alias("_a"),
        F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("frame_idx"))).alias("_b"),
        (F.min("ts_us") / 1e6).alias("onset_s"),
        F.avg((F.col("s4") == 0).cast("double")).alias("s4_zero_frac"),
        *[c.alias(name) for name, c in also.items()],
    )
    ttp = (-F.col("_peak.i") - F.col("start")) * F.col("dt_s")
    two = F.col("_n") >= 2
    return found.select(
        *key, "start", "end", (F.col("end") - F.col("start") + 1).alias("n_frames"), "onset_s", "s4_zero_frac",
        F.col("_peak.v").cast("double").alias("peak_counts"),
        ttp.alias("time_to_peak_s"),
        ((F.col("end") - F.col("start")) * F.col("dt_s")).alias("contact_time_s"),
        F.when(ttp > 0, (F.col("_peak.v") - F.col("_first")) / F.when(ttp > 0, ttp)).alias("loading_rate_cps"),
        (F.col("_sum") * F.col("dt_s")).alias("impulse_counts_s"),
        F.when(two, F.col("_path")).alias("cop_path_len"),
        F.when(two, F.hypot(F.col("_b.cop_x") - F.col("_a.cop_x"), F.col("_b.cop_y") - F.col("_a.cop_y"))).alias("cop_displacement"),
        *also,
    )


def force_features(inside):
    return stance_features(inside).select(*KEY, "start", "end", *FORCE_FEATURES)


def cop_features(inside):
    return stance_features(inside).select(*KEY, "start", "end", *COP_FEATURES)


def extract_features(frames, rep="raw", gains=None, by=("session_id",), stances=None, **detector):
    """The feature frame of a representation, from frames: of the stances given, or else of those detected."""
    return stance_features(stance_frames(frames, rep, gains, by, stances, **detector), by)


def missing():
    """The aggregate of gap_frames, over the frames of a stance."""
    return F.sum(F.when(F.col("frame_idx") > F.col("start"), F.col("last_gap")).otherwise(0))


def gap_frames(inside, by=("session_id",)):
    """Frames missing strictly inside each stance: the sum of last_gap after its first frame."""
    return inside.groupBy(*by, "stance").agg(missing().alias("gap_frames"))


def stance_metrics(inside):
    """Medial-lateral range of the centre of pressure (null under two points) and each sensor's peak, last frame left out."""
    rows = inside.filter("frame_idx < end")
    return rows.groupBy(*KEY).agg(
        F.when(F.count("cop_x") >= 2, F.max("cop_x") - F.min("cop_x")).alias("ml_range"), *[F.max(c).alias(f"peak_{c}") for c in CHANNELS]
    )


def unpivoted(rows, keep):
    """rows by channel: keep, sensor, value."""
    pairs = ", ".join(f"{i}, {c}" for i, c in enumerate(CHANNELS))
    return rows.selectExpr(*keep, f"stack({len(CHANNELS)}, {pairs}) as (sensor, value)")


def activation_timing(inside, share=0.2):
    """Per sensor: mean, population sd and count of onset (first frame at the share of its stance peak) and of peak time (s).

    Frames stay one row for all sensors, in the order of their stance; what is turned to a row a sensor are the stances.
    """
    at = (F.col("frame_idx") - F.col("start")) * F.col("dt_s")
    peak = {f"_peak_{c}": F.max(c).over(Window.partitionBy(*KEY)) for c in CHANNELS}
    found = inside.filter("frame_idx < end").withColumns(peak).groupBy(*KEY).agg(*[
        F.struct(
            F.first(f"_peak_{c}").alias("peak"),
            F.min(F.when(F.col(c) >= share * F.col(f"_peak_{c}"), at)).alias("onset_s"),
            F.min(F.when(F.col(c) == F.col(f"_peak_{c}"), at)).alias("peak_s"),
        ).alias(c) for c in CHANNELS
    ])
    times = unpivoted(found, KEY).filter("value.peak > 0").select("sensor", "value.onset_s", "value.peak_s")
    return times.groupBy("sensor").agg(
        F.avg("onset_s").alias("onset_mean_s"), F.stddev_pop("onset_s").alias("onset_sd_s"),
        F.avg("peak_s").alias("peak_mean_s"), F.stddev_pop("peak_s").alias("peak_sd_s"), F.count("*").alias("n"),
    )


def order_violations(timing, groups=((0, 1), (2,), (3, 4), (5,))):
    """Pairs of sensors whose mean onsets run against the heel-to-toe order of their groups."""
    rank = F.lit(None)
    for g, sensors in enumerate(groups):
        rank = F.when(F.col("sensor").isin(*sensors), g).otherwise(rank)
    t = timing.select("sensor", "onset_mean_s", rank.alias("grp"))
    a, b = t.alias("a"), t.alias("b")
    wrong = (F.col("a.grp") < F.col("b.grp")) & (F.col("a.onset_mean_s") > F.col("b.onset_mean_s"))
    return a.join(b, wrong).select(F.col("a.sensor").alias("earlier"), F.col("b.sensor").alias("later"))


def detection_summary(frames, events, predictions=None):
    """Counts of events by kind, and shares of extrapolating, s4 = 0 and empty frames, per session.

    With predictions(session_id, gap_frames, pred), a row a stance: n_with_gaps, n_predicted and n_no_prediction as well.
    """
    flags = frame_flags(frames).groupBy("session_id").agg(*[(100 * F.avg(F.col(c).cast("double"))).alias(f"pct_{c}") for c in ("extrapolating", "s4_zero", "all_zero")])
    kinds = ["stance", "discarded_max", "discarded_reset", "rejected_min"]
    n = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in kinds]
    out = flags.join(events.groupBy("session_id").agg(*n), "session_id", "left").fillna(0, [f"n_{k}" for k in kinds])
    if predictions is None:
        return out
    p = predictions.groupBy("session_id").agg(
        F.sum((F.coalesce("gap_frames", F.lit(0)) > 0).cast("long")).alias("n_with_gaps"), F.count("pred").alias("n_predicted"), (F.count("*") - F.count("pred")).alias("n_no_prediction")
    )
    return out.join(p, "session_id", "left").fillna(0, ["n_with_gaps", "n_predicted", "n_no_prediction"])
