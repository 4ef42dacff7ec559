"""Foot contacts (stances) in ordered frames: two-threshold detection, merging, events, and their frames.

Keys: every table carries session_id and, where clocks restart, epoch. Windows share one partitioning by session_id, so a
plan from frames to stances and features has one exchange on it. Start and end are inclusive frame numbers.
"""

import bisect

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.schemas import GAP_MERGE, MAX_DURATION, MIN_DURATION, T_OFF, T_ON


def window(by, *order):
    return Window.partitionBy(*by).orderBy(*order)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _whole(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def one_shuffle(frames):
    """The one exchange of a job over frames."""
    return frames.repartition("session_id")


def _marked(frames, value, t_on, t_off, by):
    """Frames with on (0/1 after hysteresis), run (number of the run so far), first (frame opens a run)."""
    if not t_off < t_on:
        raise ValueError("t_off must lie below t_on")
    w = window(by, "frame_idx")
    signal = F.when(F.col(value) >= t_on, 1).when(F.col(value) < t_off, 0)
    rows = frames.withColumn("_signal", signal)
    rows = rows.withColumn("on", F.coalesce(F.last("_signal", ignorenulls=True).over(upto(w)), F.lit(0)))
    rows = rows.withColumn("first", (F.col("on") == 1) & (F.coalesce(F.lag("on").over(w), F.lit(0)) == 0))
    return rows.withColumn("run", F.sum(F.col("first").cast("int")).over(upto(w)))


def find_runs(frames, value="total", t_on=T_ON, t_off=T_OFF, by=("session_id",)):
    """All runs above the thresholds: keys, start, end, n_frames."""
    return timed_runs(frames, value, t_on, t_off, by).drop("t0", "t1")


def timed_runs(frames, value="total", t_on=T_ON, t_off=T_OFF, by=("session_id",)):
    """find_runs with t0 and t1, the clock (ts_us) at start and end; null where the frames carry none."""
    on = _marked(frames, value, t_on, t_off, by).filter("on = 1")
    clock = F.col("ts_us") if "ts_us" in frames.columns else F.lit(None).cast("long")
    aggs = [F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"), F.min_by(clock, "frame_idx").alias("t0"), F.max_by(clock, "frame_idx").alias("t1")]
    return on.groupBy(*by, "run").agg(*aggs).withColumn("n_frames", F.col("end") - F.col("start") + 1).drop("run")


def find_stances(frames, value="total", t_on=T_ON, t_off=T_OFF, min_duration=MIN_DURATION, max_duration=MAX_DURATION, by=("session_id",)):
    """Runs of min_duration to max_duration frames; longer ones are dropped whole."""
    return find_runs(frames, value, t_on, t_off, by).filter(F.col("n_frames").between(min_duration, max_duration))


def merge_close(stances, gap=GAP_MERGE, by=("session_id",)):
    """Stances with fewer than gap frames between them joined, chains included: keys, stance (from 0), start, end, n_frames; t0, t1 if given."""
    w = window(by, "start")
    opens = F.coalesce(F.col("start") - F.lag("end").over(w) - 1 >= gap, F.lit(True))
    islands = stances.withColumn("_opens", opens.cast("int")).withColumn("stance", F.sum("_opens").over(upto(w)) - 1)
    clock = [F.min("t0").alias("t0"), F.max("t1").alias("t1")] if "t0" in stances.columns else []
    merged = islands.groupBy(*by, "stance").agg(F.min("start").alias("start"), F.max("end").alias("end"), *clock)
    return merged.withColumn("stance", F.col("stance").cast("int")).withColumn("n_frames", F.col("end") - F.col("start") + 1)


def stance_events(frames, value="total", t_on=T_ON, t_off=T_OFF, min_duration=MIN_DURATION, max_duration=MAX_DURATION, gap=GAP_MERGE):
    """Every decision of the detector, aware of restarts: session_id, epoch, kind, start, end, emit_idx (stances only).

    kind is stance, discarded_max (end = start + max_duration), rejected_min, discarded_reset. After a restart a run counts
    only if a frame below t_off came before it. emit_idx is the frame at which a merged stance is final: the first one at
    least gap frames (and one) after its end that lies in no live run, or the last frame of its epoch.
    """
    by = ["session_id", "epoch"]
    w = window(by, "frame_idx")
    rows = _marked(frames, value, t_on, t_off, by)
    whole = Window.partitionBy(*by)
    rows = rows.withColumns(
        {
            "_low": F.max((F.col("_signal") == 0).cast("int")).over(before(w)),
            "_last": F.max("frame_idx").over(whole),
            "_last_epoch": F.max("epoch").over(Window.partitionBy("session_id")),
        }
    )
    runs = (
        rows.filter("on = 1")
        .groupBy(*by, "run")
        .agg(
            F.min("frame_idx").alias("start"),
            F.max("frame_idx").alias("end"),
            F.min_by("_low", "frame_idx").alias("low"),
            F.first("_last").alias("last"),
            F.first("_last_epoch").alias("last_epoch"),
        )
        .filter("epoch = 0 or low = 1")
        .withColumn("n", F.col("end") - F.col("start") + 1)
    )
    runs = judged(runs, min_duration, max_duration)
    # merging, and for each merged stance the latest run that starts at or before the frame it waits for: ordered passes only
    w = window(by, "start")
    is_stance = F.coalesce(F.col("kind") == "stance", F.lit(False))
    since = F.col("start") - F.last(F.when(is_stance, F.col("end")), ignorenulls=True).over(before(w)) - 1
    runs = runs.withColumn("opens", is_stance & F.coalesce(since >= gap, F.lit(True)))
    runs = runs.withColumn("island", F.sum(F.col("opens").cast("int")).over(upto(w)))
    island = Window.partitionBy(*by, "island")
    runs = runs.withColumns({"i_start": F.min(F.when(is_stance, F.col("start"))).over(island), "i_end": F.max(F.when(is_stance, F.col("end"))).over(island)})
    points = asked(runs, by, max_duration, gap)
    return emitted(points.withColumn("live", F.last("live", ignorenulls=True).over(upto(window(by, "pos", "ask")))), by)


def judged(runs, min_duration=MIN_DURATION, max_duration=MAX_DURATION):
    """Runs (start, end, n, and last, the last frame of their epoch) with kind (null: still open, too short) and live_end."""
    is_open = F.col("end") == F.col("last")
    at_reset = is_open & (F.col("epoch") < F.col("last_epoch"))
    kind = (
        F.when(F.col("n") > max_duration, "discarded_max")
        .when(at_reset, "discarded_reset")
        .when((F.col("n") < min_duration) & is_open, F.lit(None))
        .when(F.col("n") < min_duration, "rejected_min")
        .otherwise("stance")
    )
    return runs.withColumn("kind", kind).withColumn("live_end", F.least("end", F.col("start") + max_duration - 1))


def asked(runs, by, max_duration=MAX_DURATION, gap=GAP_MERGE):
    """Points in order: each run at its start (ask = 0), and each island (i_start, i_end) at the frame that it waits for (ask = 1)."""
    shown = F.when(F.col("kind") == "discarded_max", F.col("start") + max_duration).otherwise(F.col("end"))
    point = lambda pos, ask, kind, start, end, live: F.struct(pos.alias("pos"), F.lit(ask).alias("ask"), kind.alias("kind"), start.alias("start"), end.alias("end"), live.alias("live"))
    run = point(F.col("start"), 0, F.col("kind"), F.col("start"), shown, F.col("live_end"))
    ask = point(F.greatest(F.col("i_end") + gap, F.col("i_end") + 1), 1, F.lit("stance"), F.col("i_start"), F.col("i_end"), F.lit(None).cast("bigint"))
    return runs.select(*by, "last", F.explode(F.when(F.col("opens"), F.array(run, ask)).otherwise(F.array(run))).alias("p")).select(*by, "last", "p.*")


def emitted(points, by):
    """The events of points whose live is the live end of the last run that starts at or before them."""
    emit = F.least(F.when(F.col("live") >= F.col("pos"), F.col("live") + 1).otherwise(F.col("pos")), "last")
    found = points.filter("ask = 1 or kind <> 'stance'")
    return found.select(*by, "kind", "start", "end", F.when(F.col("ask") == 1, emit).alias("emit_idx"))


def frames_in_stances(frames, value="total", t_on=T_ON, t_off=T_OFF, min_duration=MIN_DURATION, max_duration=MAX_DURATION, gap=GAP_MERGE, by=("session_id",)):
    """The frames of merged stances with stance, start, end, by windows instead of a join; frames in merged gaps belong.

    Runs and what follows each of them come in the order of the frames, so windows over (run, off, frame_idx) go on with the sort
    of the run's own window, and those of features over stances with that of the islands: three sorts in all.
    """
    by = list(by)
    rows = _marked(frames, value, t_on, t_off, by).withColumn("_off", 1 - F.col("on"))
    run = _whole(window([*by, "run", "_off"], "frame_idx"))
    w = window(by, "run", "_off", "frame_idx")
    length = F.when(F.col("on") == 1, F.count("*").over(run))
    rows = rows.withColumn("_kept", F.coalesce(length.between(min_duration, max_duration), F.lit(False)))
    rows = rows.withColumn("_at", F.when(F.col("_kept"), F.col("frame_idx")))
    since = F.col("frame_idx") - F.last("_at", ignorenulls=True).over(before(w)) - 1
    rows = rows.withColumn("_opens", F.col("_kept") & F.col("first") & F.coalesce(since >= gap, F.lit(True)))
    rows = rows.withColumn("stance", (F.sum(F.col("_opens").cast("int")).over(upto(w)) - 1).cast("int")).filter("stance >= 0")
    island = _whole(window([*by, "stance"], "frame_idx"))
    rows = rows.withColumns({"start": F.min("_at").over(island), "end": F.max("_at").over(island)})
    inside = rows.filter(F.col("frame_idx").between(F.col("start"), F.col("end")))
    return inside.drop("_signal", "on", "first", "run", "_off", "_kept", "_at", "_opens")


#: Frames of a bucket in which given intervals meet their frames.
BUCKET = 256


def numbered(intervals, by=("session_id",)):
    """Intervals (start, end) with stance, their number by start, then end, where they carry none; null and reversed ones go."""
    kept = intervals.filter("start <= end")
    if "stance" in kept.columns:
        return kept
    return kept.withColumn("stance", (F.row_number().over(window(by, "start", "end")) - 1).cast("int"))


def frames_in_intervals(frames, intervals, by=("session_id",), bucket=BUCKET):
    """The frames of given stances (start, end, inclusive; stance as in ``numbered``): a frame once for each interval that holds it.

    Frames and intervals meet in buckets of the frame numbers, in one window over their union: an interval has a row for each bucket
    that it reaches, and a bucket's frames see its intervals as one array. Overlapping, nested and equal intervals keep all their
    frames; what lies outside the session has none, and an interval without frames gives no rows. No task holds a session.
    """
    by = list(by)
    place = lambda c: F.floor(F.col(c) / bucket)
    given = numbered(intervals, by)
    spans = given.select(*by, F.struct("stance", "start", "end").alias("_span"), F.explode(F.sequence(place("start"), place("end"))).alias("_bucket"))
    own = frames.drop("stance", "start", "end").filter(F.col("frame_idx").isNotNull())
    rows = own.withColumn("_bucket", place("frame_idx")).unionByName(spans, allowMissingColumns=True)
    here = F.collect_list("_span").over(Window.partitionBy(*by, "_bucket"))
    rows = rows.withColumn("_spans", here).filter(F.col("frame_idx").isNotNull())
    holds = F.filter("_spans", lambda s: F.col("frame_idx").between(s["start"], s["end"]))
    return rows.withColumn("_s", F.explode(holds)).select(*own.columns, "_s.*")


def frame_dt(frames, by=("session_id",)):
    """Median step of the device clock in seconds, per key."""
    step = F.col("ts_us") - F.lag("ts_us").over(window(by, "frame_idx"))
    return frames.withColumn("_step", step).groupBy(*by).agg((F.median("_step") / 1e6).alias("dt_s"))


class RunningMedian:
    """The median of growing values: distinct values in order with their counts, and a pointer that moves with each new one."""

    def __init__(self):
        self.values, self.counts, self.n = [], [], 0
        self.at, self.below = 0, 0  # the value that holds the lower median, and the number of values before it

    def add(self, v):
        j = bisect.bisect_left(self.values, v)
        if j < len(self.values) and self.values[j] == v:
            self.counts[j] += 1
        else:
            self.values.insert(j, v)
            self.counts.insert(j, 1)
            if self.n and j <= self.at:
                self.at += 1
        if self.n and j < self.at:
            self.below += 1
        self.n += 1
        rank = (self.n - 1) // 2
        while self.below > rank:
            self.at -= 1
            self.below -= self.counts[self.at]
        while self.below + self.counts[self.at] <= rank:
            self.below += self.counts[self.at]
            self.at += 1

    def median(self):
        low = self.values[self.at]
        other = self.at + (self.below + self.counts[self.at] <= self.n // 2)
        return (low + self.values[other]) / 2


def running_dt(frames):
    """Frames with dt_s: the median step of the epoch so far, in seconds; null on an epoch's first frame.

    One ordered pass over the frames of a session; what a task holds is the distinct steps of one epoch.
    """
    rows = frames.repartition("session_id").sortWithinPartitions("session_id", "epoch", "frame_idx")

    def run(batches):
        import pyarrow as pa

        key, before, median = None, None, None
        for batch in batches:
            out = []
            for s, e, ts in zip(*(batch.column(c).to_pylist() for c in ("session_id", "epoch", "ts_us"))):
                if median is None or (s, e) != key:
                    key, before, median = (s, e), None, RunningMedian()
                if before is not None and ts is not None:
                    median.add(ts - before)
                before = ts
                out.append(median.median() / 1e6 if median.n else None)
            yield batch.append_column("dt_s", pa.array(out, pa.float64()))

    return rows.mapInArrow(run, frames.withColumn("dt_s", F.lit(None).cast("double")).schema)


def count_windows(frames, length, stride, value="total"):
    """Full windows of length frames every stride frames: session_id, window, values (array in order)."""
    i = F.col("frame_idx")
    first = F.greatest(F.ceil((i - length + 1) / stride), F.lit(0))
    rows = frames.select("session_id", "frame_idx", value, F.explode(F.sequence(first.cast("bigint"), F.floor(i / stride).cast("bigint"))).alias("window"))
    packed = rows.groupBy("session_id", "window").agg(F.sort_array(F.collect_list(F.struct("frame_idx", value))).alias("v"))
    return packed.filter(F.size("v") == length).select("session_id", "window", F.transform("v", lambda x: x[value]).alias("values"))


def threshold_sweep(frames, candidates, value="total", t_on=T_ON, t_off=T_OFF, min_duration=MIN_DURATION, gap=GAP_MERGE):
    """Stances kept per session for each candidate ceiling of duration; detection runs once."""
    runs = find_runs(frames, value, t_on, t_off)
    each = runs.withColumn("max_duration", F.explode(F.array(*[F.lit(c) for c in candidates])))
    kept = each.filter(F.col("n_frames").between(F.lit(min_duration), F.col("max_duration")))
    merged = merge_close(kept.select("session_id", "max_duration", "start", "end"), gap, ["session_id", "max_duration"])
    return merged.groupBy("session_id", "max_duration").agg(F.count("*").alias("n_stances"))
