"""Link accounting and stances of sessions of any length: a session is cut into segments, and no task holds more than one.

The counters of the link and the two-threshold automaton are functions that compose. A first pass over a segment gives its summary
(what it does to the state at its start, a row), a scan over the summaries of a session gives each segment's entry state, and a
second pass applies it. Runs and islands of stances that go on across a cut are pieces at the ends of their segments, at
most two a segment, and only those meet again. What looks back a bounded number of frames (is the last stance closer than the gap,
is a run of at most max_duration frames still live) takes the rows that lie that near before a segment along with it.

Results are those of ``link_lines``, ``find_runs``, ``find_stances``, ``merge_close`` and ``stance_events``, wherever the cuts lie:
every ``size`` lines or frames, or at the values of a column ``segment`` that does not fall from frame to frame.
"""

from pyspark.sql import functions as F

from strideforge.operators.link import breaks
from strideforge.operators.store import written
from strideforge.operators.stances import asked, before, emitted, judged, upto, window
from strideforge.schemas import FRAME_PERIOD_US, GAP_MERGE, MAX_DURATION, MIN_DURATION, T_OFF, T_ON, TIMING_TOLERANCE_US

#: Frames or lines of a segment: about three hours of one sensor, and some hundred thousand summaries for a sensor's life.
SIZE = 1_000_000


def cut(rows, order, by=("session_id",), size=SIZE):
    """rows with their segment, dealt out by it: the one exchange of the rows."""
    if "segment" not in rows.columns:
        rows = rows.withColumn("segment", F.floor(F.col(order) / size))
    return rows.repartition(*by, "segment")


def entered(rows, entries, by):
    """rows with the entry state of their segment."""
    return rows.join(entries, [*by, "segment"])


def link_lines(parsed, size=SIZE, period=FRAME_PERIOD_US, tolerance=TIMING_TOLERANCE_US):
    """``link.link_lines`` over segments of parsed lines."""
    by = ["session_id"]
    w = window([*by, "segment"], "line_no")
    valid = F.col("status") == "valid"
    rows = cut(parsed, "line_no", by, size)
    rows = rows.withColumn("_b", F.sum((F.col("status") == "bad_checksum").cast("long")).over(upto(w)))
    rows = rows.withColumn("_v", F.when(valid, F.struct("seq", "ts_us", F.col("_b").alias("_bad"))))
    rows = rows.withColumns({"_q": F.last("_v", ignorenulls=True).over(before(w)), "_m": F.count("_v").over(upto(w))})
    at = F.when(valid, F.col("line_no"))
    summary = rows.groupBy(*by, "segment").agg(
        F.max("_b").alias("bad"), F.max("_m").alias("valid"), F.min_by("ts_us", at).alias("first_ts"), F.max_by("_v", at).alias("v"),
        F.sum((valid & (F.col("ts_us") < F.col("_q.ts_us"))).cast("int")).alias("resets"),
    )
    s = before(window(by, "segment"))
    total = lambda c: F.coalesce(F.sum(c).over(s), F.lit(0)).cast("long")
    summary = summary.withColumns({"bad_before": total("bad"), "valid_before": total("valid")})
    summary = summary.withColumn("v", F.when(F.col("v").isNotNull(), F.struct("v.seq", "v.ts_us", (F.col("v._bad") + F.col("bad_before")).alias("_bad"))))
    summary = summary.withColumn("entry", F.last("v", ignorenulls=True).over(s))
    summary = summary.withColumn("all_resets", F.coalesce("resets", F.lit(0)) + F.coalesce(F.col("first_ts") < F.col("entry.ts_us"), F.lit(False)).cast("int"))
    entries = summary.select(*by, "segment", "bad_before", "valid_before", "entry", total("all_resets").alias("epoch_before"))
    rows = entered(rows, entries, by)
    own = F.struct("_q.seq", "_q.ts_us", (F.col("_q._bad") + F.col("bad_before")).alias("_bad"))
    rows = rows.withColumns({"_bad": F.col("_b") + F.col("bad_before"), "_n": F.col("_m") + F.col("valid_before"), "_p": F.when(F.col("_q").isNotNull(), own).otherwise(F.col("entry"))})
    rows = breaks(rows, period, tolerance)
    here = F.sum(F.coalesce("reset", F.lit(False)).cast("int")).over(upto(w))
    rows = rows.withColumn("epoch", (F.col("epoch_before") + here).cast("int"))
    return rows.drop("_b", "_v", "_q", "_m", "_bad", "_n", "_p", "entry", "segment", "bad_before", "valid_before", "epoch_before")


def _chain(pieces, by, order, goes_on):
    """Numbers along the pieces at cuts, by order: the same for a piece that goes on with the one before it."""
    return pieces.withColumn("_chain", F.sum((~goes_on).cast("long")).over(upto(window(by, *order))))


def _runs(frames, value, t_on, t_off, by, size):
    """Runs above the thresholds with start, end, t0, t1 and, from the epoch's summaries, low (a frame below t_off came before), last."""
    if not t_off < t_on:
        raise ValueError("t_off must lie below t_on")
    by = list(by)
    w = window([*by, "segment"], "frame_idx")
    signal = F.when(F.col(value) >= t_on, 1).when(F.col(value) < t_off, 0)
    clock = F.col("ts_us") if "ts_us" in frames.columns else F.lit(None).cast("long")
    own = frames.select(*by, "frame_idx", signal.alias("_signal"), clock.alias("ts_us"), *[c for c in frames.columns if c == "segment"])
    rows = cut(written(own, "signals"), "frame_idx", by, size)
    told = F.when(F.col("_signal").isNotNull(), F.col("frame_idx"))
    summary = rows.groupBy(*by, "segment").agg(F.max_by("_signal", told).alias("exit"), F.max((F.col("_signal") == 0).cast("int")).alias("low"), F.max("frame_idx").alias("high"))
    s = window(by, "segment")
    entries = summary.select(
        *by, "segment", F.coalesce(F.last("exit", ignorenulls=True).over(before(s)), F.lit(0)).alias("_entry"),
        F.max("low").over(before(s)).alias("_low_before"), F.max("high").over(s.rowsBetween(-(2**63), 2**63 - 1)).alias("last"),
    )
    rows = entered(rows, entries, by)
    rows = rows.withColumn("on", F.coalesce(F.last("_signal", ignorenulls=True).over(upto(w)), F.col("_entry")))
    rows = rows.withColumns({
        "_low": F.greatest(F.max((F.col("_signal") == 0).cast("int")).over(before(w)), F.col("_low_before")),
        "_was": F.lag("on").over(w), "_right": F.lead("on").over(w).isNull(),
    })
    opens = (F.col("on") == 1) & (F.coalesce(F.col("_was"), F.lit(0)) == 0)
    rows = rows.withColumn("_run", F.sum(opens.cast("int")).over(upto(w)))
    pieces = rows.filter("on = 1").groupBy(*by, "segment", "_run").agg(
        F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"), F.min_by("ts_us", "frame_idx").alias("t0"), F.max_by("ts_us", "frame_idx").alias("t1"),
        F.min_by("_low", "frame_idx").alias("low"), F.first("last").alias("last"),
        F.max(F.col("_was").isNull() & (F.col("_entry") == 1)).alias("_goes_on"), F.max("_right").alias("_right"),
    )
    keep = [*by, "start", "end", "t0", "t1", "low", "last"]
    inner = pieces.filter("not _goes_on and not _right").select(*keep)
    edge = _chain(pieces.filter("_goes_on or _right"), by, ["segment", "start"], F.col("_goes_on"))
    met = edge.groupBy(*by, "_chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("t0", "start").alias("t0"), F.max_by("t1", "start").alias("t1"),
        F.min_by("low", "start").alias("low"), F.first("last").alias("last"),
    )
    return inner.union(met.select(*keep))


def timed_runs(frames, value="total", t_on=T_ON, t_off=T_OFF, by=("session_id",), size=SIZE):
    """``stances.timed_runs`` over segments of frames."""
    runs = _runs(frames, value, t_on, t_off, by, size)
    return runs.select(*by, "start", "end", "t0", "t1", (F.col("end") - F.col("start") + 1).alias("n_frames"))


def find_runs(frames, value="total", t_on=T_ON, t_off=T_OFF, by=("session_id",), size=SIZE):
    """``stances.find_runs`` over segments of frames."""
    return timed_runs(frames, value, t_on, t_off, by, size).drop("t0", "t1")


def find_stances(frames, value="total", t_on=T_ON, t_off=T_OFF, min_duration=MIN_DURATION, max_duration=MAX_DURATION, by=("session_id",), size=SIZE):
    """``stances.find_stances`` over segments of frames."""
    return find_runs(frames, value, t_on, t_off, by, size).filter(F.col("n_frames").between(min_duration, max_duration))


def _with_near(rows, at, near, size):
    """rows by the segment that their place lies in, and those less than near frames before a segment once more for it (_near)."""
    reach = F.floor((F.col(at) + near) / size)
    return rows.withColumn("segment", F.explode(F.sequence(F.floor(F.col(at) / size), reach))).withColumn("_near", F.floor(F.col(at) / size) < F.col("segment"))


def _islands(stances, gap, by, max_duration, size):
    """Stances with opens, numbered along each session (island), and each island's bounds, by segments.

    A stance of at most max_duration frames whose end is less than gap away began less than max_duration + gap frames before, so
    copies of the stances that near before a segment are enough to see which stances go on with an earlier one.
    """
    rows = _with_near(stances, "start", max_duration + max(gap, 0) + 1, size).repartition(*by, "segment")
    w = window([*by, "segment"], "start")
    opens = F.coalesce(F.col("start") - F.lag("end").over(w) - 1 >= gap, F.lit(True))
    rows = rows.withColumn("opens", opens).filter("not _near").drop("_near")
    rows = rows.withColumn("_k", F.sum(F.col("opens").cast("long")).over(upto(w)))
    summary = rows.groupBy(*by, "segment").agg(F.max("_k").alias("_opened"))
    entries = summary.select(*by, "segment", F.coalesce(F.sum("_opened").over(before(window(by, "segment"))), F.lit(0)).alias("_before"))
    return entered(rows, entries, by).withColumn("island", F.col("_before") + F.col("_k") - 1).drop("_k", "_before", "segment")


def merge_close(stances, gap=GAP_MERGE, by=("session_id",), max_duration=MAX_DURATION, size=SIZE):
    """``stances.merge_close`` by segments, for stances of at most max_duration frames."""
    by = list(by)
    rows = _islands(stances, gap, by, max_duration, size)
    clock = [F.min("t0").alias("t0"), F.max("t1").alias("t1")] if "t0" in stances.columns else []
    merged = rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *clock)
    out = merged.withColumn("stance", F.col("island").cast("int")).withColumn("n_frames", F.col("end") - F.col("start") + 1)
    return out.select(*by, "stance", "start", "end", *(["t0", "t1"] if clock else []), "n_frames")


def stance_events(frames, value="total", t_on=T_ON, t_off=T_OFF, min_duration=MIN_DURATION, max_duration=MAX_DURATION, gap=GAP_MERGE, size=SIZE):
    """``stances.stance_events`` over segments of frames."""
    by = ["session_id", "epoch"]
    runs = _runs(frames, value, t_on, t_off, by, size)
    last_epoch = frames.groupBy("session_id").agg(F.max("epoch").alias("last_epoch"))
    runs = runs.filter("epoch = 0 or low = 1").withColumn("n", F.col("end") - F.col("start") + 1)
    runs = written(judged(runs.join(last_epoch, "session_id"), min_duration, max_duration), "runs")
    is_stance = F.coalesce(F.col("kind") == "stance", F.lit(False))
    found = written(_islands(runs.filter(is_stance), gap, by, max_duration, size), "islands")
    bounds = found.groupBy(*by, "island").agg(F.min("start").alias("i_start"), F.max("end").alias("i_end"))
    opened = found.filter("opens").join(bounds, [*by, "island"]).drop("island")
    none = F.lit(None).cast("long")
    others = runs.filter(~is_stance).withColumns({"opens": F.lit(False), "i_start": none, "i_end": none})
    later = found.filter("not opens").drop("island").withColumns({"i_start": none, "i_end": none})
    points = asked(opened.unionByName(others).unionByName(later), by, max_duration, gap)
    # a run that is live at a place began at most max_duration frames before it
    points = _with_near(points, "pos", max_duration + 1, size).filter("not _near or ask = 0").repartition(*by, "segment")
    points = points.withColumn("live", F.last("live", ignorenulls=True).over(upto(window([*by, "segment"], "pos", "ask"))))
    return emitted(points.filter("not _near").drop("_near", "segment"), by)
