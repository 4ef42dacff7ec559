"""Accounting of the link: lost frames, sequence and timing breaks, restarts, reports and verdicts per capture."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.schemas import BLE_LOSS_LIMIT, FRAME_PERIOD_US, TIMING_TOLERANCE_US

WRAP = 65_536


def by_session(*order):
    return Window.partitionBy("session_id").orderBy(*order)


def link_lines(parsed, period=FRAME_PERIOD_US, tolerance=TIMING_TOLERANCE_US):
    """Parsed lines of all kinds, the valid ones with frame_idx, epoch, lost, seq_break, timing_break, reset, last_gap.

    One exchange on session_id: all windows share its order. A restart (time runs backwards) counts as nothing else. Frames
    rejected for their checksum since the last valid frame are missing from the sequence but not lost.
    """
    w = by_session("line_no")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    valid = F.col("status") == "valid"
    rows = parsed.withColumn("_bad", F.sum((F.col("status") == "bad_checksum").cast("long")).over(upto))
    rows = rows.withColumn("_v", F.when(valid, F.struct("seq", "ts_us", "_bad")))
    rows = rows.withColumns({"_p": F.last("_v", ignorenulls=True).over(before), "_n": F.count("_v").over(upto)})
    rows = breaks(rows, period, tolerance)
    return rows.withColumn("epoch", F.sum(F.coalesce("reset", F.lit(False)).cast("int")).over(upto).cast("int")).drop("_bad", "_v", "_p", "_n")


def breaks(rows, period=FRAME_PERIOD_US, tolerance=TIMING_TOLERANCE_US):
    """Lines with what their predecessor tells: frame_idx, reset, last_gap, lost, seq_break, timing_break; null where not valid.

    _p: the last valid line before (seq, ts_us, _bad); _bad, _n: lines with a wrong checksum and valid ones up to here.
    """
    valid = F.col("status") == "valid"
    reset = F.coalesce(F.col("ts_us") < F.col("_p.ts_us"), F.lit(False))
    delta = F.when(~F.col("reset"), F.pmod(F.col("seq") - F.col("_p.seq"), F.lit(WRAP)))
    missing = F.greatest(F.col("_delta") - 1, F.lit(0))
    gap = F.greatest(F.col("last_gap") - (F.col("_bad") - F.col("_p._bad")), F.lit(0))
    no = F.lit(False)
    here = lambda c: F.when(valid, c)
    return (
        rows.withColumn("frame_idx", here(F.col("_n") - 1).cast("long"))
        .withColumn("reset", here(reset))
        .withColumn("_delta", here(delta))
        .withColumn("last_gap", here(F.coalesce(missing, F.lit(0)).cast("long")))
        .withColumn("lost", here(F.when(F.col("_delta").isNull(), 0).otherwise(gap).cast("long")))
        .withColumn("seq_break", here(F.coalesce((F.col("_delta") != 1) & ((F.col("lost") > 0) | (F.col("_delta") == 0)), no)))
        .withColumn("timing_break", here(F.coalesce((F.col("_delta") > 0) & (F.abs(F.col("ts_us") - F.col("_p.ts_us") - period * F.col("_delta")) > tolerance), no)))
        .drop("_delta")
    )


def link_accounting(parsed, period=FRAME_PERIOD_US, tolerance=TIMING_TOLERANCE_US):
    """The valid frames of ``link_lines``."""
    return link_lines(parsed, period, tolerance).filter("status = 'valid'").drop("status", "value")


def capture_report(lines, duration_s=None, at="arrival_ts"):
    """One row per session of link_lines: all counters, loss percentage, device seconds; one aggregate over one pass.

    Where the lines carry arrival times: host_s, from the first to the last valid frame; and with the duration asked for,
    short_s, what it lacks, where that is more than a second (else null).
    """
    valid = F.col("status") == "valid"
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}")
    aggs = [n(s) for s in ("valid", "malformed", "empty", "bad_checksum", "status")]
    aggs += [F.coalesce(F.sum("lost"), F.lit(0)).alias("lost")]
    aggs += [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"{c}s") for c in ("seq_break", "timing_break", "reset")]
    aggs += [((F.max_by("ts_us", "frame_idx") - F.min_by("ts_us", "frame_idx")) / 1e6).alias("device_s")]
    timed = at in lines.columns
    if timed:
        t = F.unix_micros(F.when(valid, F.col(at)))
        aggs.append(((F.max(t) - F.min(t)) / 1e6).alias("host_s"))
    report = lines.groupBy("session_id").agg(*aggs)
    report = report.withColumn("loss_pct", F.coalesce(F.try_divide(100.0 * F.col("lost"), F.col("n_valid") + F.col("lost")), F.lit(0.0)))
    if timed and duration_s is not None:
        short = duration_s - F.coalesce("host_s", F.lit(0.0))
        report = report.withColumn("short_s", F.when(short > 1.0, short))
    return report


def capture_verdict(report, transport="serial", loss_limit=BLE_LOSS_LIMIT):
    """The report with verdict: ok or the first reason to fail, by transport (ble allows a share of loss)."""
    corrupt = (F.col("n_malformed") > 0) | (F.col("n_bad_checksum") > 0)
    out = F.when(corrupt, "corruption").when(F.col("resets") > 0, "reset").when(F.col("n_valid") == 0, "no_frames")
    if transport == "ble":
        out = out.when(F.col("loss_pct") > loss_limit, "loss").when(F.col("timing_breaks") > 0, "timing")
    else:
        out = out.when(F.col("lost") > 0, "loss").when(F.col("seq_breaks") > 0, "sequence").when(F.col("timing_breaks") > 0, "timing")
    return report.withColumn("verdict", out.otherwise("ok"))


def stalls(arrivals, limit_s=3.0, key="session_id", at="arrival_ts"):
    """Rows that come more than limit_s seconds after their predecessor of the session, with gap_s."""
    gap = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(Window.partitionBy(key).orderBy(at)))) / 1e6
    return arrivals.withColumn("gap_s", gap).filter(F.col("gap_s") > limit_s)


def capture_window(arrivals, duration_s, slack_s=5.0, key="session_id", at="arrival_ts"):
    """Rows up to duration_s + slack_s seconds after the session's first."""
    since = F.unix_micros(at) - F.unix_micros(F.min(at).over(Window.partitionBy(key)))
    return arrivals.withColumn("_since", since).filter(F.col("_since") <= int((duration_s + slack_s) * 1e6)).drop("_since")
