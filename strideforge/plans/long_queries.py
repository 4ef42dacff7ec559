"""Queries over long sessions, given stances and further forms of operators that other modules hold in their plain form.

Their twins are those of the plain forms where the results are the same.
"""

from pyspark.sql import functions as F

from strideforge.operators import evaluate as ev
from strideforge.operators import features as ft
from strideforge.operators import reports, segments
from strideforge.operators import stances as st
from strideforge.operators.store import written
from strideforge.plans import adapter as ad
from strideforge.plans import frame_queries as fq
from strideforge.plans import model_queries as mq
from strideforge.plans.common import normal
from strideforge.sources import streams
from strideforge.streaming import live

Q, SQL = {}, {}
#: Frames of a segment here: short, so that every session is cut many times, through stances as well.
CUT = 97


def add(name, sql=None):
    def put(f):
        Q[name] = lambda spark, d: normal(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return put


@add("w1_segments", fq.SQL["w1_link_accounting"])
def link_segments(spark, d):
    rows = segments.link_lines(fq.parsed(spark, d), size=CUT).filter("status = 'valid'")
    return rows.select("session_id", "frame_idx", "seq", "lost", "seq_break", "timing_break", "reset", "last_gap")


@add("w3_segments", fq.SQL["w3_find_stances"])
def stance_segments(spark, d):
    return segments.find_stances(fq.fr(spark, d), size=CUT)


@add("w5_segments", fq.SQL["w5_merge_close"])
def merged_segments(spark, d):
    return segments.merge_close(segments.find_stances(fq.fr(spark, d), size=CUT), size=CUT)


@add("w6_w7_segments", fq.SQL["w6_w7_stance_events"])
def event_segments(spark, d):
    return segments.stance_events(fq.accounted(spark, d), size=CUT)


# Intervals every 40 frames, 30, 65 or 100 frames long: most overlap others, the last ones reach beyond the session.
GIVEN = """merged AS (
  SELECT session_id, k AS stance, k * 40 + session_id % 7 AS start, k * 40 + session_id % 7 + 30 + (k % 3) * 35 AS "end"
  FROM (SELECT session_id, unnest(range(0, max(frame_idx) // 40 + 1)) AS k FROM frames GROUP BY session_id)
)"""


def given(frames):
    sessions = frames.groupBy("session_id").agg(F.max("frame_idx").alias("last"))
    each = sessions.withColumn("stance", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("last div 40"))))
    start = F.col("stance") * 40 + F.col("session_id") % 7
    return each.select("session_id", "stance", start.alias("start"), (start + 30 + (F.col("stance") % 3) * 35).alias("end"))


@add("a6_given_stances", f"""
WITH {fq.features_sql("conductance", found=GIVEN)}
SELECT session_id, stance, start, "end", n_frames, round(onset_s, 6) AS onset_s, round(s4_zero_frac, 6) AS s4_zero_frac, {fq.ROUNDED} FROM feats""")
def given_features(spark, d):
    frames = ad.frames(spark, d)
    found = ft.extract_features(frames, "conductance", stances=given(frames))
    return found.select("session_id", "stance", "start", "end", "n_frames", "onset_s", "s4_zero_frac", *fq.FEATS)


@add("a6_adjoining_stances", f"""
WITH {fq.features_sql(found=GIVEN.replace("k * 40 + session_id % 7 + 30 + (k % 3) * 35", "(k + 1) * 40 + session_id % 7 - 1"))}
SELECT session_id, count(*) AS n, round(sum(peak_counts), 6) AS peaks, round(sum(impulse_counts_s), 6) AS impulses FROM feats GROUP BY session_id""")
def adjoining_features(spark, d):
    """Given intervals without a stance number that adjoin each other."""
    frames = ad.frames(spark, d)
    each = given(frames).select("session_id", "start", (F.col("start") + 39).alias("end"))
    found = ft.extract_features(frames, stances=each)
    return found.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("peak_counts").alias("peaks"), F.sum("impulse_counts_s").alias("impulses"))


@add("j2_given_stances", f"""
WITH {fq.F_}, {GIVEN}
SELECT m.session_id, m.stance, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, min(frame_idx) AS first, max(frame_idx) AS last
FROM merged m JOIN frames f ON f.session_id = m.session_id AND f.frame_idx BETWEEN m.start AND m."end" GROUP BY m.session_id, m.stance""")
def given_frames(spark, d):
    frames = fq.fr(spark, d)
    rows = st.frames_in_intervals(frames, given(frames))
    return rows.groupBy("session_id", "stance").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))


# Arrivals with silences: a line comes every 2.5 ms by its number; in the middle some sessions fall silent for 7 s, later some for 4 s.
ARRIVED_US = "1704067200000000 + line_no * 2500 + CASE WHEN session_id % 3 = 0 AND line_no >= 1200 THEN 7000000 ELSE 0 END + CASE WHEN session_id % 5 = 0 AND line_no >= 2000 THEN 4000000 ELSE 0 END"
#: Seconds at which a micro-batch of the arrivals ends.
ENDS = (1.7, 4.0, 9.0)
STALL_US, STATUS_US = 3_000_000, 1_000_000
CAPTURES = f"""
WITH {fq.PARSED}, came AS (SELECT session_id, line_no, status, {ARRIVED_US} AS us FROM parsed),
gaps AS (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY line_no) AS before FROM came),
numbered_captures AS (
  SELECT *, sum(CASE WHEN us - before > {STALL_US} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS capture FROM gaps
), captures AS (SELECT session_id, capture, min(us) AS t0, max(us) AS t1, max(max(us)) OVER () AS mark, max(capture) OVER (PARTITION BY session_id) AS last FROM numbered_captures GROUP BY session_id, capture),
closed AS (
  SELECT *, capture < last OR -(-(t1 + {STALL_US}) // 1000) < mark // 1000 AS stalled FROM captures
)"""


def watched(spark, d, **settings):
    """Events of the live job over the arrivals with silences, by the clock of the arrivals."""
    lines = written(ad.lines(spark, d), "lines").withColumn("_us", F.expr(ARRIVED_US))
    part = sum(((F.col("_us") > 1704067200000000 + int(e * 1e6)).cast("int") for e in ENDS), F.lit(0))
    rows = lines.withColumn("arrival_ts", F.timestamp_micros("_us")).withColumn("_part", part).drop("_us")
    parts = [rows.filter(F.col("_part") == k).drop("_part") for k in range(len(ENDS) + 1)]
    return mq.arrived(spark, parts, lambda stream: live.live_stances(stream, clock="arrival", stall_s=STALL_US / 1e6, **settings))


@add("t7_stall_stream", f"""{CAPTURES}
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(t1 + {STALL_US} AS BIGINT) AS at_us FROM closed WHERE stalled""")
def stall_stream(spark, d):
    return watched(spark, d).filter("kind = 'stalled'").select("session_id", F.unix_micros("at").alias("at_us"))


KINDS = ("valid", "malformed", "empty", "bad_checksum", "status")


@add("t8_status_stream", f"""{CAPTURES}, due AS (
  SELECT session_id, capture, t0 + {STATUS_US} * unnest(range(1, (t1 - t0 + {STALL_US}) // {STATUS_US} + 2)) AS at_us, t1, mark, stalled FROM closed
)
SELECT CAST(d.session_id AS VARCHAR) AS session_id, CAST(at_us AS BIGINT) AS at_us, {", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in KINDS)}
FROM due d JOIN numbered_captures n ON n.session_id = d.session_id AND n.capture = d.capture AND n.us <= d.at_us
WHERE at_us < t1 + {STALL_US} AND (stalled OR at_us < t1 OR -(-at_us // 1000) < mark // 1000) GROUP BY d.session_id, d.capture, at_us""")
def status_stream(spark, d):
    rows = watched(spark, d, status_s=STATUS_US / 1e6).filter("kind = 'status'")
    return rows.select("session_id", F.unix_micros("at").alias("at_us"), *[F.element_at("counters", F.lit(k)).alias(k) for k in KINDS])


def logged(spark, d, model=None, names=()):
    """Events of the live job from plain text logs, one a session: those of every other session come first, then the rest."""
    lines = ad.lines(spark, d)
    ends = lines.groupBy("session_id").agg((F.max("line_no") + 1).alias("line_no")).withColumn("value", F.lit(live.END))
    rows = lines.unionByName(ends).withColumn("odd", F.col("session_id") % 2)
    base = mq.shared(spark)
    for odd in (0, 1):
        one = rows.filter(F.col("odd") == odd).repartition("session_id").sortWithinPartitions("session_id", "line_no")
        one.select("session_id", "value").write.mode("append").partitionBy("session_id").text(f"{base}/logs")
        stream = streams.line_stream(spark, f"{base}/logs", "log", session="session_id=([^/]+)/")
        found = live.run_now(live.live_stances(stream, model, names, stall_s=None), f"{base}/out", f"{base}/ck")
    return found


@add("t1_log_stream_events", fq.SQL.get("t2_t6_live_events") or mq.SQL["t2_t6_live_events"])
def log_events(spark, d):
    return logged(spark, d).filter("kind <> 'end'").select("session_id", "kind", "epoch", "start", "end", "emit_idx")


# ---- groups and families of any size -----------------------------------------------------------------------------------
@add("a14_refined", fq.SQL["a14_force_distribution"])
def force_refined(spark, d):
    return reports.force_distribution(ad.once(ad.frames(spark, d), "frames"), refined=True)


@add("a17_refined", mq.SQL["a17_describe_features"])
def features_refined(spark, d):
    return reports.describe_features(mq.fe(spark, d), mq.X, refined=True)


@add("a22_refined", mq.SQL["a22_band_overlap"])
def bands_refined(spark, d):
    return reports.band_overlap(mq.fe(spark, d), "x0", refined=True)


@add("e5_holm_rows", f"""
WITH {mq.FE}, t AS (SELECT row_id, abs(x0) / 1000 AS p FROM feats),
r AS (SELECT *, row_number() OVER (ORDER BY p, row_id) AS r, count(*) OVER () AS m FROM t)
SELECT row_id, round(least(max((m - r + 1) * p) OVER (ORDER BY p, row_id ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_holm FROM r""")
def holm_rows(spark, d):
    """A test for each row: the family is the whole table."""
    tests = mq.fe(spark, d).select("row_id", (F.abs("x0") / 1000).alias("p"))
    return ev.holm(tests).select("row_id", "p_holm")
