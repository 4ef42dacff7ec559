"""Queries over lines and frames of the adapter, with their DuckDB twins."""

from pyspark.sql import functions as F

from strideforge.functions import frames as fx
from strideforge.operators import features as ft
from strideforge.operators import link, matching, reports
from strideforge.operators import stances as st
from strideforge.plans import adapter as ad
from strideforge.plans.common import normal
from strideforge.schemas import CENTRES_MM, LENGTH_MM, MAX_DURATION, MIN_DURATION

MODEL = {
    "kind": "qda", "classes": ["fast", "shuffle", "walk"], "means": [[1.2, 0.6], [0.9, 0.5], [1.4, 0.65]], "priors": [0.3, 0.4, 0.3],
    "covs": [[[0.05, 0.01], [0.01, 0.02]], [[0.04, 0.0], [0.0, 0.03]], [[0.06, 0.01], [0.01, 0.03]]],
}
CH = [f"s{i}" for i in range(6)]
TOTAL = " + ".join(CH)


def fr(spark, d):
    return ad.frames(spark, d).withColumn("total", fx.total_force())


def parsed(spark, d):
    return fx.parse_frames(ad.lines(spark, d))


def lined(spark, d):
    return link.link_lines(parsed(spark, d))


def accounted(spark, d):
    return link.link_accounting(parsed(spark, d)).withColumn("total", fx.total_force())


# ---- DuckDB building blocks -------------------------------------------------------------------------------------------
F_ = ad.FRAMES_SQL
RUNS = """
marked AS (
  SELECT *, CASE WHEN total >= 1200 THEN 1 WHEN total < 450 THEN 0 END AS sig FROM frames
), filled AS (
  SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS on_ FROM marked
), edged AS (
  SELECT *, CASE WHEN on_ = 1 AND coalesce(lag(on_) OVER (PARTITION BY session_id ORDER BY frame_idx), 0) = 0 THEN 1 ELSE 0 END AS first_ FROM filled
), numbered AS (
  SELECT *, sum(first_) OVER (PARTITION BY session_id ORDER BY frame_idx) AS run FROM edged
), runs AS (
  SELECT session_id, min(frame_idx) AS start, max(frame_idx) AS "end", max(frame_idx) - min(frame_idx) + 1 AS n_frames FROM numbered WHERE on_ = 1 GROUP BY session_id, run
), stances AS (SELECT * FROM runs WHERE n_frames BETWEEN 15 AND 200), opened AS (
  SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY session_id ORDER BY start) - 1 >= 12, true) THEN 1 ELSE 0 END AS o FROM stances
), islands AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY start) - 1 AS island FROM opened),
merged AS (
  SELECT session_id, CAST(island AS BIGINT) AS stance, min(start) AS start, max("end") AS "end", max("end") - min(start) + 1 AS n_frames FROM islands GROUP BY session_id, island
)"""


def cop_sql(channels, axis, prefix=""):
    total = " + ".join(f"{prefix}{c}" for c in channels)
    weighted = " + ".join(f"{prefix}{c} * CAST({CENTRES_MM[i][axis] / LENGTH_MM!r} AS DOUBLE)" for i, c in enumerate(channels))
    return f"CASE WHEN ({total}) <> 0 THEN ({weighted}) / CAST(({total}) AS DOUBLE) END"


def rep_sql(rep):
    """Channels of a representation, as SQL."""
    x = lambda c: f"(least({c}, 4094) / CAST(4095 - least({c}, 4094) AS DOUBLE))"
    return {"raw": lambda i: f"s{i}", "conductance": lambda i: x(f"s{i}"), "gain_matched": lambda i: f"({x(f's{i}')} * {ad.GAINS[i]!r})"}[rep]


def features_sql(rep="raw", source=F_, found=RUNS):
    """The chain from frames to feats; source: the SQL that makes frames, found: that which makes the stances, merged."""
    return f"""{source}, {found}, steps AS (
  SELECT session_id, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY frame_idx) AS step FROM frames
), dts AS (SELECT session_id, median(step) / 1e6 AS dt_s FROM steps GROUP BY session_id),
inside AS (
  SELECT f.*, m.stance, m.start, m."end", d.dt_s, {loads_sql(rep)} FROM frames f JOIN merged m ON f.session_id = m.session_id AND f.frame_idx BETWEEN m.start AND m."end"
  JOIN dts d ON d.session_id = f.session_id
), {tail_sql()}"""


def loads_sql(rep):
    r = rep_sql(rep)
    return ", ".join(f"{r(i)} AS r{i}" for i in range(6))


def tail_sql():
    """From the frames inside stances to their features."""
    rs = [f"r{i}" for i in range(6)]
    return f"""loaded AS (SELECT *, {' + '.join(rs)} AS load, {cop_sql(rs, 0)} AS cx, {cop_sql(rs, 1)} AS cy FROM inside),
open_ AS (SELECT * FROM loaded WHERE frame_idx < "end"),
points AS (
  SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM open_ WHERE cx IS NOT NULL WINDOW w AS (PARTITION BY session_id, stance ORDER BY frame_idx)
), paths AS (
  SELECT session_id, stance, count(*) AS n, sum(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py))) AS path,
    sqrt(power(arg_max(cx, frame_idx) - arg_min(cx, frame_idx), 2) + power(arg_max(cy, frame_idx) - arg_min(cy, frame_idx), 2)) AS disp
  FROM points GROUP BY session_id, stance
), peaks AS (
  SELECT session_id, stance, min(start) AS start, min("end") AS "end", min(dt_s) AS dt_s, max(load) AS peak, arg_min(load, frame_idx) AS first_load, sum(load) AS total_load FROM open_ GROUP BY session_id, stance
), tops AS (
  SELECT o.session_id, o.stance, min(o.frame_idx) - min(o.start) AS at FROM open_ o JOIN peaks p ON o.session_id = p.session_id AND o.stance = p.stance AND o.load = p.peak GROUP BY o.session_id, o.stance
), ctx AS (SELECT session_id, stance, min(ts_us) / 1e6 AS onset_s, avg(CASE WHEN s4 = 0 THEN 1.0 ELSE 0.0 END) AS z FROM inside GROUP BY session_id, stance),
feats AS (
  SELECT p.session_id, p.stance, p.start, p."end", p."end" - p.start + 1 AS n_frames, c.onset_s, c.z AS s4_zero_frac, CAST(p.peak AS DOUBLE) AS peak_counts, t.at * p.dt_s AS time_to_peak_s,
    (p."end" - p.start) * p.dt_s AS contact_time_s, CASE WHEN t.at > 0 THEN (p.peak - p.first_load) / (t.at * p.dt_s) END AS loading_rate_cps, p.total_load * p.dt_s AS impulse_counts_s,
    CASE WHEN q.n >= 2 THEN q.path END AS cop_path_len, CASE WHEN q.n >= 2 THEN q.disp END AS cop_displacement
  FROM peaks p JOIN tops t USING (session_id, stance) JOIN ctx c USING (session_id, stance) LEFT JOIN paths q USING (session_id, stance)
)"""


FEATS = ["peak_counts", "time_to_peak_s", "contact_time_s", "loading_rate_cps", "impulse_counts_s", "cop_path_len", "cop_displacement"]
R = lambda c, a=None: f"round({c}, 6) AS {a or c}"
ROUNDED = ", ".join(R(f) for f in FEATS)
PARSED = f"""{F_}, {ad.LINES_SQL}, pieces AS (
  SELECT *, trim(value) AS v, string_split(trim(value), ',') AS f FROM lines
), ints AS (
  SELECT *, {', '.join(f"CASE WHEN regexp_full_match(coalesce(f[{i + 2}], ''), '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim(f[{i + 2}]) AS BIGINT) END AS n{i}" for i in range(9))} FROM pieces
), parsed AS (
  SELECT session_id, line_no, value, CASE WHEN v = '' THEN 'empty' WHEN v[1] = '#' THEN 'status' WHEN len(f) <> 10 OR f[1] <> 'INS' OR {' OR '.join(f'n{i} IS NULL' for i in range(9))} THEN 'malformed'
    WHEN (((n0 + n1 + n2 + n3 + n4 + n5 + n6 + n7) % 256) + 256) % 256 <> n8 THEN 'bad_checksum' WHEN {' OR '.join(f'n{i} NOT BETWEEN 0 AND 4095' for i in range(2, 8))} THEN 'malformed' ELSE 'valid' END AS status,
    n0 AS seq, n1 AS ts_us, n2 AS s0, n3 AS s1, n4 AS s2, n5 AS s3, n6 AS s4, n7 AS s5 FROM ints
)"""
ACCOUNTED = f"""{PARSED}, credited AS (
  SELECT *, sum(CASE WHEN status = 'bad_checksum' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS bad FROM parsed
), lagged AS (
  SELECT *, row_number() OVER w - 1 AS frame_idx, lag(seq) OVER w AS pseq, lag(ts_us) OVER w AS pts, bad - lag(bad) OVER w AS credit FROM credited WHERE status = 'valid' WINDOW w AS (PARTITION BY session_id ORDER BY line_no)
), deltas AS (
  SELECT *, coalesce(ts_us < pts, false) AS reset, CASE WHEN NOT coalesce(ts_us < pts, false) THEN ((seq - pseq) % 65536 + 65536) % 65536 END AS delta FROM lagged
), gaps AS (SELECT *, coalesce(greatest(delta - 1, 0), 0) AS last_gap, CASE WHEN delta IS NULL THEN 0 ELSE CAST(greatest(greatest(delta - 1, 0) - credit, 0) AS BIGINT) END AS lost FROM deltas),
accounted AS (
  SELECT *, coalesce(delta <> 1 AND (lost > 0 OR delta = 0), false) AS seq_break, coalesce(delta > 0 AND abs(ts_us - pts - 10000 * delta) > 3000, false) AS timing_break,
    sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS epoch FROM gaps
)"""
REPORT = f"""{ACCOUNTED}, kinds AS (
  SELECT session_id, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ('valid', 'malformed', 'empty', 'bad_checksum', 'status'))} FROM parsed GROUP BY session_id
), links AS (
  SELECT session_id, CAST(sum(lost) AS BIGINT) AS lost, count(*) FILTER (WHERE seq_break) AS seq_breaks, count(*) FILTER (WHERE timing_break) AS timing_breaks, count(*) FILTER (WHERE reset) AS resets,
    (arg_max(ts_us, frame_idx) - arg_min(ts_us, frame_idx)) / 1e6 AS device_s FROM accounted GROUP BY session_id
), report AS (SELECT k.*, coalesce(lost, 0) AS lost, coalesce(seq_breaks, 0) AS seq_breaks, coalesce(timing_breaks, 0) AS timing_breaks, coalesce(resets, 0) AS resets, device_s,
  coalesce(100.0 * lost / nullif(n_valid + lost, 0), 0) AS loss_pct FROM kinds k LEFT JOIN links USING (session_id))"""
EVENTS = f"""{ACCOUNTED}, erows AS (SELECT *, s0 + s1 + s2 + s3 + s4 + s5 AS total FROM accounted), esig AS (SELECT *, CASE WHEN total >= 1200 THEN 1 WHEN total < 450 THEN 0 END AS sig FROM erows),
efill AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY session_id, epoch ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS on_,
  max(CASE WHEN sig = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, epoch ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low,
  max(frame_idx) OVER (PARTITION BY session_id, epoch) AS last_, max(epoch) OVER (PARTITION BY session_id) AS last_epoch FROM esig),
eedge AS (SELECT *, CASE WHEN on_ = 1 AND coalesce(lag(on_) OVER (PARTITION BY session_id, epoch ORDER BY frame_idx), 0) = 0 THEN 1 ELSE 0 END AS first_ FROM efill),
enum AS (SELECT *, sum(first_) OVER (PARTITION BY session_id, epoch ORDER BY frame_idx) AS run FROM eedge),
eruns AS (SELECT session_id, epoch, min(frame_idx) AS start, max(frame_idx) AS "end", arg_min(coalesce(low, 0), frame_idx) AS low, min(last_) AS last_, min(last_epoch) AS last_epoch FROM enum WHERE on_ = 1 GROUP BY session_id, epoch, run),
ekinds AS (SELECT *, CASE WHEN "end" - start + 1 > 200 THEN 'discarded_max' WHEN "end" = last_ AND epoch < last_epoch THEN 'discarded_reset' WHEN "end" - start + 1 < 15 AND "end" = last_ THEN NULL
  WHEN "end" - start + 1 < 15 THEN 'rejected_min' ELSE 'stance' END AS kind, least("end", start + 199) AS live_end FROM eruns WHERE epoch = 0 OR low = 1),
eopen AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY session_id, epoch ORDER BY start) - 1 >= 12, true) THEN 1 ELSE 0 END AS o FROM ekinds WHERE kind = 'stance'),
eisl AS (SELECT *, sum(o) OVER (PARTITION BY session_id, epoch ORDER BY start) AS island FROM eopen),
emerged AS (SELECT session_id, epoch, min(start) AS start, max("end") AS "end", min(last_) AS last_ FROM eisl GROUP BY session_id, epoch, island),
eemit AS (SELECT m.session_id, m.epoch, m.start, m."end", least(m.last_, coalesce(max(r.live_end) + 1, m."end" + 12)) AS emit_idx FROM emerged m LEFT JOIN ekinds r
  ON m.session_id = r.session_id AND m.epoch = r.epoch AND m."end" + 12 BETWEEN r.start AND r.live_end GROUP BY m.session_id, m.epoch, m.start, m."end", m.last_),
events_ AS (SELECT session_id, CAST(epoch AS BIGINT) AS epoch, 'stance' AS kind, start, "end", emit_idx FROM eemit UNION ALL
  SELECT session_id, CAST(epoch AS BIGINT), kind, start, CASE WHEN kind = 'discarded_max' THEN start + 200 ELSE "end" END, NULL FROM ekinds WHERE kind <> 'stance')"""


def per_session_counts(rows, *keys):
    return rows.groupBy("session_id", *keys).agg(F.count("*").alias("n"))


def events(spark, d):
    return st.stance_events(accounted(spark, d))


def inside(spark, d, rep="raw"):
    return ft.stance_frames(ad.frames(spark, d), rep, ad.GAINS)


def flagship(spark, d):
    """Lines to classified stances: parse, account, detect, features, predict."""
    from strideforge.operators.models import predict

    f = link.link_accounting(parsed(spark, d))  # its exchange on session_id serves the windows by session and epoch as well
    rows = ft.extract_features(f, by=("session_id", "epoch"))
    return normal(predict(rows, MODEL, ["cop_path_len", "cop_displacement"]))


def encoded(spark, d):
    e = fx.encode_frames(ad.frames(spark, d))
    back = fx.parse_frames(e.select("session_id", F.col("frame_idx").alias("line_no"), "value"))
    return back.groupBy("session_id", "status").agg(F.count("*").alias("n"), F.sum("s3").alias("s3"), F.min(F.length("value")).alias("shortest"))


def kv(spark, d):
    k = fx.parse_kv(ad.lines(spark, d).filter("value like '#%'"))
    return k.groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.element_at("kv", F.lit("notif")).try_cast("bigint")).alias("notif"))


def reassembled(spark, d):
    from strideforge.sources.logs import reassemble_lines

    text = ad.lines(spark, d).select("session_id", F.col("line_no").alias("n"), F.concat("value", F.lit("\n")).alias("b"))
    cut = text.select("session_id", F.explode(F.array(F.struct((F.col("n") * 2).alias("chunk_no"), F.substring("b", 1, 7).alias("bytes")), F.struct((F.col("n") * 2 + 1).alias("chunk_no"), F.expr("substring(b, 8)").alias("bytes")))).alias("c"))
    lines = reassemble_lines(cut.select("session_id", "c.*"))
    return lines.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def timed_stances(spark, d):
    return st.merge_close(st.timed_runs(fr(spark, d)).filter(F.col("n_frames").between(MIN_DURATION, MAX_DURATION)))


def gap_frames(spark, d):
    a = accounted(spark, d)
    return ft.gap_frames(st.frames_in_stances(a)).groupBy("session_id").agg(F.sum("gap_frames").alias("gap_frames"), F.count("*").alias("n"))


def dt_at_emit(spark, d):
    a = ad.once(accounted(spark, d), "accounted")
    dt = st.running_dt(a).select("session_id", "epoch", F.col("frame_idx").alias("emit_idx"), "dt_s")
    return st.stance_events(a).filter("kind = 'stance'").join(dt, ["session_id", "epoch", "emit_idx"]).select("session_id", "start", "end", "dt_s")


def emitted_counts(spark, d):
    a = accounted(spark, d)
    return ft.detection_summary(a, st.stance_events(a))


def predictions(a):
    """A row for each stance of accounted frames: features by epoch, gap_frames and the model's class."""
    from strideforge.operators.models import predict

    by = ["session_id", "epoch"]
    rows = ft.stance_features(ft.stance_frames(a, by=by), by, {"gap_frames": ft.missing()}).dropna(subset=by)
    return predict(rows, MODEL, ["cop_path_len", "cop_displacement"])


def truth(spark, d):
    """Periodic truth intervals of the moving sessions: frames 0..60 % of each period."""
    f = ad.frames(spark, d).filter("label <> 'stand'").groupBy("session_id", "label").agg(F.max("frame_idx").alias("last"))
    period = F.when(F.col("label") == "walk", 100).when(F.col("label") == "fast", 60).otherwise(50)
    t = f.withColumn("p", period).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("last div p"))))
    return t.select("session_id", (F.col("k") * F.col("p")).alias("start"), (F.col("k") * F.col("p") + F.expr("p * 6 div 10")).alias("end"))


def conduct(c, fs=4095):
    return f"CASE WHEN {c} > 0 AND {c} < {fs} THEN {c} / CAST({fs} - {c} AS DOUBLE) END"


FITS = {0: {"a": 12.5, "b": 0.4, "flag": "ok", "x_min": 0.05, "x_max": 1.5}, 2: {"a": 9.0, "b": -1.0, "flag": "ok", "x_min": 0.1, "x_max": 2.0}, 3: {"a": 1.0, "b": 0.0, "flag": "flat", "x_min": 0.0, "x_max": 9.0}}


def sums(df, *cols):
    return df.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in cols], *[F.count(c).alias(f"n_{c}") for c in cols])


def sql_sums(source, *exprs):
    cells = ", ".join(f"round(sum({e}), 6) AS {a}, count({e}) AS n_{a}" for a, e in exprs)
    return f"WITH {F_} SELECT session_id, {cells} FROM {source} GROUP BY session_id"


def model_sql(model, x, y):
    """The class of the highest score of a two-feature model, null where a feature is."""
    scores = []
    for (mx, my), ((a, b), (_, c)), prior in zip(model["means"], model["covs"], model["priors"]):
        det = f"({a} * {c} - {b} * {b})"
        dx, dy = f"({x} - {mx})", f"({y} - {my})"
        scores.append(f"(-0.5 * ({c} * {dx} * {dx} - 2 * {b} * {dx} * {dy} + {a} * {dy} * {dy}) / {det} - 0.5 * ln({det}) + ln({prior}))")
    best = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {v} = {best} THEN '{c}'" for c, v in zip(model["classes"], scores))
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL {cases} END"


#: Frames with session and epoch as one key, so that the chain of the features serves epochs as well.
EPOCH_FRAMES = f"frames AS (SELECT session_id * 100 + epoch AS session_id, frame_idx, ts_us, last_gap, {', '.join(CH)}, {TOTAL} AS total FROM (WITH {ACCOUNTED} SELECT * FROM accounted))"
FLAGSHIP = f"""WITH {features_sql("raw", EPOCH_FRAMES)}, flagship AS (SELECT CAST(session_id // 100 AS BIGINT) AS session_id, CAST(session_id % 100 AS BIGINT) AS epoch, stance, start, "end", n_frames, round(onset_s, 6) AS onset_s, round(s4_zero_frac, 6) AS s4_zero_frac,
  {ROUNDED}, {model_sql(MODEL, "cop_path_len", "cop_displacement")} AS pred FROM feats)"""
LIVE = f"""WITH {EVENTS}, ids AS (SELECT *, row_number() OVER (ORDER BY session_id, epoch, start) AS id FROM eemit), ist AS (SELECT session_id, epoch, frame_idx, ts_us - lag(ts_us) OVER (PARTITION BY session_id, epoch ORDER BY frame_idx) AS step FROM accounted),
idt AS (SELECT i.id, median(step) / 1e6 AS dt_s FROM ids i JOIN ist s ON i.session_id = s.session_id AND i.epoch = s.epoch AND s.frame_idx <= i.emit_idx GROUP BY i.id),
inside AS (SELECT i.id AS session_id, 0 AS stance, i.start, i."end", d.dt_s, a.frame_idx, a.ts_us, a.last_gap, {', '.join(f'a.s{i}' for i in range(6))}, {loads_sql("raw")} FROM ids i JOIN idt d ON d.id = i.id
  JOIN accounted a ON a.session_id = i.session_id AND a.epoch = i.epoch AND a.frame_idx BETWEEN i.start AND i."end"),
{tail_sql()}, igaps AS (SELECT session_id, CAST(sum(CASE WHEN frame_idx > start THEN last_gap ELSE 0 END) AS BIGINT) AS gap_frames FROM inside GROUP BY session_id)
SELECT CAST(i.session_id AS VARCHAR) AS session_id, CAST(i.epoch AS BIGINT) AS epoch, i.start, i."end", g.gap_frames, round(d.dt_s, 6) AS dt_s, {ROUNDED}, {model_sql(MODEL, "cop_path_len", "cop_displacement")} AS pred
FROM ids i JOIN idt d ON d.id = i.id JOIN igaps g ON g.session_id = i.id JOIN feats f ON f.session_id = i.id"""
Q, SQL = {}, {"flagship": f"{FLAGSHIP} SELECT * FROM flagship"}


def add(name, sql=None):
    def put(f):
        Q[name] = lambda spark, d: normal(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return put


add("p1_parse_lines", f"WITH {PARSED} SELECT session_id, status, count(*) AS n, CAST(sum(seq) FILTER (WHERE status = 'valid') AS BIGINT) AS seq, CAST(sum(s2) FILTER (WHERE status = 'valid') AS BIGINT) AS s2 FROM parsed GROUP BY session_id, status")(
    lambda s, d: parsed(s, d).groupBy("session_id", "status").agg(F.count("*").alias("n"), F.sum("seq").alias("seq"), F.sum("s2").alias("s2"))
)
add("p2_checksum", f"WITH {F_} SELECT session_id, CAST(sum((((seq + ts_us + total) % 256) + 256) % 256) AS BIGINT) AS c FROM frames GROUP BY session_id")(
    lambda s, d: ad.frames(s, d).withColumn("c", fx.checksum("seq", "ts_us", *CH)).groupBy("session_id").agg(F.sum("c").alias("c"))
)
add("io4_encode_frames", f"""WITH {F_}, e AS (SELECT *, concat_ws(',', 'INS', seq, ts_us, s0, s1, s2, s3, s4, s5, (((seq + ts_us + total) % 256) + 256) % 256) AS v FROM frames)
SELECT session_id, 'valid' AS status, count(*) AS n, CAST(sum(s3) AS BIGINT) AS s3, CAST(min(length(v)) AS BIGINT) AS shortest FROM e GROUP BY session_id""")(encoded)
add("p3_parse_kv", f"WITH {F_}, {ad.LINES_SQL} SELECT session_id, count(*) AS n, max(CAST(regexp_extract(value, 'notif=([0-9]+)', 1) AS BIGINT)) AS notif FROM lines WHERE value LIKE '#%' GROUP BY session_id")(kv)
add("io5_reassemble_lines", f"WITH {F_}, {ad.LINES_SQL} SELECT session_id, count(*) AS n, CAST(sum(length(trim(value))) AS BIGINT) AS chars FROM lines WHERE trim(value) <> '' GROUP BY session_id")(reassembled)
add("p4_clean", f"WITH {F_} SELECT session_id, count(*) AS n, count(*) FILTER (WHERE greatest(s0, s1, s2, s3, s4, s5) > 3000) AS dropped FROM frames GROUP BY session_id")(
    lambda s, d: (lambda f: per_session_counts(f).join(per_session_counts(fx.clean(f, 3000)).withColumnRenamed("n", "kept"), "session_id", "left").select("session_id", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped")))(ad.once(ad.frames(s, d), "frames"))
)
add("p5_total_force", f"WITH {F_} SELECT session_id, CAST(sum(total) AS BIGINT) AS total, count(total) AS n_total FROM frames GROUP BY session_id")(lambda s, d: sums(fr(s, d), "total"))
_all = lambda f: {f"c{i}": f(f"s{i}") for i in range(6)}
add("p6_conductance", sql_sums("frames", *[(f"c{i}", conduct(f"s{i}")) for i in range(6)]))(lambda s, d: sums(ad.frames(s, d).withColumns(_all(fx.conductance)), *_all(str)))
add("p7_saturated", f"WITH {F_} SELECT session_id, count(*) FILTER (WHERE s0 >= 3200 - 25) AS n FROM frames GROUP BY session_id")(
    lambda s, d: ad.frames(s, d).groupBy("session_id").agg(F.sum(fx.is_saturated("s0", 3200).cast("bigint")).alias("n"))
)
add("p8_conductance_capped", sql_sums("frames", *[(f"c{i}", rep_sql("conductance")(i)) for i in range(6)]))(lambda s, d: sums(ad.frames(s, d).withColumns(_all(fx.conductance_capped)), *_all(str)))
add("p9_transform", sql_sums("frames", *[(f"s{i}", rep_sql("gain_matched")(i)) for i in range(6)]))(lambda s, d: sums(fx.transform(ad.frames(s, d), "gain_matched", ad.GAINS), *CH))
add("p10_apply_gain_match", sql_sums("frames", *[(f"g{i}", f"CASE WHEN s{i} < 4070 THEN ({conduct(f's{i}')}) * {ad.GAINS[i]!r} END") for i in range(6)]))(
    lambda s, d: sums(fx.apply_gain_match(ad.frames(s, d), ad.GAINS), *[f"g{i}" for i in range(6)])
)
_force = lambda i, f: f"CASE WHEN s{i} < 4070 AND ({conduct(f's{i}')}) BETWEEN {f['x_min']} AND {f['x_max']} THEN greatest({f['a']} * ({conduct(f's{i}')}) + ({f['b']}), 0.0) END"
add("p11_apply_calibration", sql_sums("frames", ("f0", _force(0, FITS[0])), ("f2", _force(2, FITS[2]))))(lambda s, d: sums(fx.apply_calibration(ad.frames(s, d), FITS, extrapolate=False, clamp=True), "f0", "f2"))
add("p13_centre_of_pressure", sql_sums("frames", ("cop_x", cop_sql(CH, 0)), ("cop_y", cop_sql(CH, 1))))(lambda s, d: sums(fx.cop(ad.frames(s, d)), "cop_x", "cop_y"))
add("p14_frame_flags", f"WITH {F_} SELECT session_id, count(*) FILTER (WHERE greatest(s0, s1, s2, s3, s4, s5) > 824) AS extrapolating, count(*) FILTER (WHERE s4 = 0) AS s4_zero, count(*) FILTER (WHERE greatest(s0, s1, s2, s3, s4, s5) = 0) AS all_zero FROM frames GROUP BY session_id")(
    lambda s, d: fx.frame_flags(ad.frames(s, d)).groupBy("session_id").agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("extrapolating", "s4_zero", "all_zero")])
)
_s4 = ["s0", "s1", "s2", "s3", "m4", "s5"]
_dx, _dy = (f"({cop_sql(_s4, a)} - {cop_sql(CH, a)}) * 274.0" for a in (0, 1))
add("p16_zero_channel_effect", f"""WITH {F_}, med AS (SELECT label, median(s4) FILTER (WHERE s4 > 0) AS m4 FROM frames GROUP BY label), hit AS (SELECT f.*, m4 FROM frames f JOIN med USING (label) WHERE s4 = 0 AND total > 0 AND m4 IS NOT NULL)
SELECT label, count(*) AS n, round(avg({_dx}), 6) AS dx_mm, round(avg({_dy}), 6) AS dy_mm, round(avg(sqrt(power({_dx}, 2) + power({_dy}, 2))), 6) AS dist_mm FROM hit GROUP BY label""")(lambda s, d: reports.zero_channel_effect(ad.frames(s, d), by=["label"]))
_g = [f"({rep_sql('gain_matched')(i)})" for i in range(6)]
_d = f"sqrt(power(({cop_sql(_g, 0)} - {cop_sql(CH, 0)}) * 274.0, 2) + power(({cop_sql(_g, 1)} - {cop_sql(CH, 1)}) * 274.0, 2))"
add("p17_representation_shift", f"WITH {F_}, x AS (SELECT label, {_d} AS dd FROM frames) SELECT label, count(*) AS n, round(avg(dd), 6) AS mean_mm, round(median(dd), 6) AS median_mm FROM x WHERE dd IS NOT NULL GROUP BY label")(
    lambda s, d: reports.representation_shift(ad.frames(s, d), gains=ad.GAINS, by=["label"])
)
add("w1_link_accounting", f"WITH {ACCOUNTED} SELECT session_id, frame_idx, seq, lost, seq_break, timing_break, reset, last_gap FROM accounted")(
    lambda s, d: accounted(s, d).select("session_id", "frame_idx", "seq", "lost", "seq_break", "timing_break", "reset", "last_gap")
)
add("w2_epochs", f"WITH {ACCOUNTED} SELECT session_id, CAST(epoch AS BIGINT) AS epoch, count(*) AS n, min(frame_idx) AS first FROM accounted GROUP BY session_id, epoch")(
    lambda s, d: accounted(s, d).groupBy("session_id", "epoch").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"))
)
add("w3_find_stances", f'WITH {F_}, {RUNS} SELECT session_id, start, "end", n_frames FROM stances')(lambda s, d: st.find_stances(fr(s, d)))
add("w4_find_runs", f'WITH {F_}, {RUNS} SELECT session_id, start, "end", n_frames FROM runs')(lambda s, d: st.find_runs(fr(s, d)))
add("w5_merge_close", f'WITH {F_}, {RUNS} SELECT session_id, stance, start, "end", n_frames FROM merged')(lambda s, d: st.merge_close(st.find_stances(fr(s, d))))
add("w6_w7_stance_events", f"WITH {EVENTS} SELECT * FROM events_")(events)
add("w8_frame_dt", f"WITH {F_}, s AS (SELECT session_id, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY frame_idx) AS step FROM frames) SELECT session_id, round(median(step) / 1e6, 6) AS dt_s FROM s GROUP BY session_id")(lambda s, d: st.frame_dt(ad.frames(s, d)))
add("w9_running_dt", f"""WITH {EVENTS}, st AS (SELECT session_id, epoch, frame_idx, ts_us - lag(ts_us) OVER (PARTITION BY session_id, epoch ORDER BY frame_idx) AS step FROM accounted)
SELECT e.session_id, e.start, e."end", round(median(s.step) / 1e6, 6) AS dt_s FROM eemit e JOIN st s ON e.session_id = s.session_id AND e.epoch = s.epoch AND s.frame_idx <= e.emit_idx GROUP BY e.session_id, e.epoch, e.start, e."end" """)(dt_at_emit)
_acc_runs = RUNS.replace("FROM frames", "FROM aframes")
add("w10_gap_frames", f"""WITH {ACCOUNTED}, aframes AS (SELECT *, s0 + s1 + s2 + s3 + s4 + s5 AS total FROM accounted), {_acc_runs}
SELECT m.session_id, CAST(sum(CASE WHEN f.frame_idx > m.start THEN f.last_gap ELSE 0 END) AS BIGINT) AS gap_frames, count(DISTINCT m.stance) AS n FROM merged m JOIN aframes f ON f.session_id = m.session_id AND f.frame_idx BETWEEN m.start AND m."end" GROUP BY m.session_id""")(gap_frames)
add("w11_count_windows", f"""WITH {F_}, n AS (SELECT session_id, count(*) AS n FROM frames GROUP BY session_id), w AS (SELECT session_id, unnest(range(0, CASE WHEN n >= 50 THEN (n - 50) // 20 + 1 ELSE 0 END)) AS "window" FROM n)
SELECT w.session_id, w."window", CAST(sum(total) AS BIGINT) AS total, count(*) AS n FROM w JOIN frames f ON f.session_id = w.session_id AND f.frame_idx >= w."window" * 20 AND f.frame_idx < w."window" * 20 + 50 GROUP BY 1, 2""")(
    lambda s, d: st.count_windows(fr(s, d), 50, 20).select("session_id", "window", F.aggregate("values", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("values").alias("n"))
)
add("w12_timing_report", f"""WITH {F_}, x AS (SELECT *, ts_us - lag(ts_us) OVER w AS step, ((seq - lag(seq) OVER w) % 65536 + 65536) % 65536 AS dl FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx))
SELECT session_id, count(*) AS n_frames, round((arg_max(ts_us, frame_idx) - arg_min(ts_us, frame_idx)) / 1e6, 6) AS duration_s, count(*) FILTER (WHERE dl <> 1) AS seq_gaps, round(median(step), 6) AS step_median, min(step) AS step_min, max(step) AS step_max,
round(stddev_pop(step), 6) AS step_sd, round(quantile_cont(step, 0.75) - quantile_cont(step, 0.25), 6) AS step_iqr FROM x GROUP BY session_id""")(lambda s, d: reports.timing_report(ad.frames(s, d)))
add("w14_coverage_report", f"""WITH {F_}, {RUNS}, e AS (SELECT m.*, a.ts_us AS t0, b.ts_us AS t1 FROM merged m JOIN frames a ON a.session_id = m.session_id AND a.frame_idx = m.start JOIN frames b ON b.session_id = m.session_id AND b.frame_idx = m."end"),
g AS (SELECT *, (t0 - lag(t1) OVER (PARTITION BY session_id ORDER BY start)) / 1e6 AS gap_s FROM e), r AS (SELECT session_id, CAST(sum(n_frames) AS BIGINT) AS frames_natural FROM runs GROUP BY session_id)
SELECT session_id, round(min(t0) / 1e6, 6) AS first_onset_s, round(max(t1) / 1e6, 6) AS last_end_s, round(max(gap_s), 6) AS largest_gap_s, CAST(sum(n_frames) AS BIGINT) AS frames_kept, min(frames_natural) AS frames_natural FROM g JOIN r USING (session_id) GROUP BY session_id""")(
    lambda s, d: reports.coverage_report(timed_stances(s, d), st.find_runs(fr(s, d)))
)
_report_cols = "session_id, n_valid, n_malformed, n_empty, n_bad_checksum, n_status, lost, seq_breaks, timing_breaks, resets, round(device_s, 6) AS device_s, round(loss_pct, 6) AS loss_pct"
add("a1_capture_report", f"WITH {REPORT} SELECT {_report_cols} FROM report")(lambda s, d: link.capture_report(lined(s, d)))
_arrive = "1704067200000000 + line_no * 2600 + session_id * 1000"
add("a1_host_seconds", f"""WITH {PARSED}, t AS (SELECT session_id, count(*) FILTER (WHERE status = 'valid') AS n_valid, (max({_arrive}) FILTER (WHERE status = 'valid') - min({_arrive}) FILTER (WHERE status = 'valid')) / 1e6 AS host_s FROM parsed GROUP BY session_id)
SELECT session_id, n_valid, round(host_s, 6) AS host_s, round(CASE WHEN 6.5 - coalesce(host_s, 0) > 1 THEN 6.5 - coalesce(host_s, 0) END, 6) AS short_s FROM t""")(
    lambda s, d: link.capture_report(link.link_lines(fx.parse_frames(ad.lines(s, d).withColumn("arrival_ts", F.expr(f"timestamp_micros({_arrive})")))), 6.5).select("session_id", "n_valid", "host_s", "short_s")
)
_verdict = "CASE WHEN n_malformed > 0 OR n_bad_checksum > 0 THEN 'corruption' WHEN resets > 0 THEN 'reset' WHEN n_valid = 0 THEN 'no_frames' WHEN {} THEN 'loss' {} WHEN timing_breaks > 0 THEN 'timing' ELSE 'ok' END"
add("a2_capture_verdict", f"WITH {REPORT} SELECT session_id, {_verdict.format('lost > 0', 'WHEN seq_breaks > 0 THEN ' + chr(39) + 'sequence' + chr(39))} AS serial, {_verdict.format('loss_pct > 2.0', '')} AS ble FROM (SELECT * REPLACE (0 AS n_malformed, CASE WHEN session_id % 2 = 0 THEN 0 ELSE n_bad_checksum END AS n_bad_checksum) FROM report)")(
    lambda s, d: (lambda r: link.capture_verdict(r).withColumnRenamed("verdict", "serial").join(link.capture_verdict(r, "ble").select("session_id", F.col("verdict").alias("ble")), "session_id").select("session_id", "serial", "ble"))(
        link.capture_report(lined(s, d)).withColumns({"n_malformed": F.lit(0), "n_bad_checksum": F.when(F.col("session_id") % 2 == 0, 0).otherwise(F.col("n_bad_checksum"))})
    )
)
add("a3_detection_summary", f"""WITH {EVENTS}, fl AS (SELECT session_id, round(100 * avg(CASE WHEN greatest(s0, s1, s2, s3, s4, s5) > 824 THEN 1.0 ELSE 0.0 END), 6) AS pct_extrapolating, round(100 * avg(CASE WHEN s4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_s4_zero,
round(100 * avg(CASE WHEN greatest(s0, s1, s2, s3, s4, s5) = 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_all_zero FROM accounted GROUP BY session_id)
SELECT fl.*, {', '.join(f"(SELECT count(*) FROM events_ e WHERE e.session_id = fl.session_id AND kind = '{k}') AS n_{k}" for k in ('stance', 'discarded_max', 'discarded_reset', 'rejected_min'))} FROM fl""")(emitted_counts)
_RUNS_E = RUNS.replace("FROM frames", "FROM (SELECT *, s0 + s1 + s2 + s3 + s4 + s5 AS total FROM accounted)").replace("PARTITION BY session_id", "PARTITION BY session_id, epoch").replace("SELECT session_id,", "SELECT session_id, epoch,").replace("GROUP BY session_id", "GROUP BY session_id, epoch")
add("a3_predictions", f"""WITH {ACCOUNTED}, {_RUNS_E}, p AS (SELECT m.session_id, m.epoch, m.stance, sum(CASE WHEN a.frame_idx > m.start THEN a.last_gap ELSE 0 END) AS gaps, count(*) FILTER (WHERE a.frame_idx < m."end" AND s0 + s1 + s2 + s3 + s4 + s5 > 0) AS points
  FROM merged m JOIN accounted a ON a.session_id = m.session_id AND a.epoch = m.epoch AND a.frame_idx BETWEEN m.start AND m."end" GROUP BY 1, 2, 3),
n AS (SELECT session_id, count(*) FILTER (WHERE gaps > 0) AS n_with_gaps, count(*) FILTER (WHERE points >= 2) AS n_predicted, count(*) FILTER (WHERE points < 2) AS n_no_prediction FROM p GROUP BY session_id)
SELECT s.session_id, coalesce(n_with_gaps, 0) AS n_with_gaps, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_no_prediction, 0) AS n_no_prediction FROM (SELECT DISTINCT session_id FROM accounted) s LEFT JOIN n USING (session_id)""")(
    lambda s, d: (lambda a: ft.detection_summary(a, st.stance_events(a), predictions(a)).select("session_id", "n_with_gaps", "n_predicted", "n_no_prediction"))(ad.once(accounted(s, d), "accounted"))
)
_force_cols = ", ".join(R(f) for f in FEATS[:5])
add("a4_force_features", f'WITH {features_sql()} SELECT session_id, stance, start, "end", {_force_cols} FROM feats')(lambda s, d: ft.force_features(inside(s, d)))
add("a5_cop_features", f'WITH {features_sql()} SELECT session_id, stance, start, "end", {", ".join(R(f) for f in FEATS[5:])} FROM feats')(lambda s, d: ft.cop_features(inside(s, d)))
for _rep in ("raw", "conductance", "gain_matched"):
    add(f"a6_features_{_rep}", f'WITH {features_sql(_rep)} SELECT session_id, stance, start, "end", n_frames, round(onset_s, 6) AS onset_s, round(s4_zero_frac, 6) AS s4_zero_frac, {ROUNDED} FROM feats')(
        lambda s, d, r=_rep: ft.extract_features(ad.frames(s, d), r, ad.GAINS)
    )
add("a7_stance_context", f"WITH {features_sql()} SELECT session_id, stance, round(onset_s, 6) AS onset_s, round(s4_zero_frac, 6) AS s4_zero_frac FROM feats")(lambda s, d: ft.stance_features(inside(s, d)).select("session_id", "stance", "onset_s", "s4_zero_frac"))
add("a8_stance_metrics", f"WITH {features_sql()} SELECT session_id, stance, CASE WHEN count(cx) >= 2 THEN round(max(cx) - min(cx), 6) END AS ml_range, {', '.join(f'CAST(max(s{i}) AS BIGINT) AS peak_s{i}' for i in range(6))} FROM open_ GROUP BY session_id, stance")(lambda s, d: ft.stance_metrics(inside(s, d)))
_long = " UNION ALL ".join(f"SELECT session_id, stance, start, frame_idx, dt_s, {i} AS sensor, s{i} AS value FROM open_" for i in range(6))
_TIMING = f"""{features_sql()}, lng AS ({_long}), pk AS (SELECT *, max(value) OVER (PARTITION BY session_id, stance, sensor) AS peak FROM lng),
tm AS (SELECT session_id, stance, sensor, min(CASE WHEN value >= 0.2 * peak THEN (frame_idx - start) * dt_s END) AS onset_s, min(CASE WHEN value = peak THEN (frame_idx - start) * dt_s END) AS peak_s FROM pk WHERE peak > 0 GROUP BY 1, 2, 3),
timing AS (SELECT CAST(sensor AS BIGINT) AS sensor, avg(onset_s) AS onset_mean_s, stddev_pop(onset_s) AS onset_sd_s, avg(peak_s) AS peak_mean_s, stddev_pop(peak_s) AS peak_sd_s, count(*) AS n FROM tm GROUP BY sensor)"""
add("a9_activation_timing", f"WITH {_TIMING} SELECT sensor, {', '.join(R(c) for c in ('onset_mean_s', 'onset_sd_s', 'peak_mean_s', 'peak_sd_s'))}, n FROM timing")(lambda s, d: ft.activation_timing(inside(s, d)))
_grp = "CASE WHEN sensor < 2 THEN 0 WHEN sensor = 2 THEN 1 WHEN sensor < 5 THEN 2 ELSE 3 END"
add("a9_order_violations", f"WITH {_TIMING}, g AS (SELECT *, {_grp} AS grp FROM timing) SELECT a.sensor AS earlier, b.sensor AS later FROM g a JOIN g b ON a.grp < b.grp AND a.onset_mean_s > b.onset_mean_s")(lambda s, d: ft.order_violations(ft.activation_timing(inside(s, d))))
_flong = "fl AS (" + " UNION ALL ".join(f"SELECT session_id, label, {i} AS sensor, s{i} AS value FROM frames" for i in range(6)) + ")"
add("a10_channel_summary", f"WITH {F_}, {_flong} SELECT session_id, CAST(sensor AS BIGINT) AS sensor, CAST(min(value) AS BIGINT) AS min, round(median(value), 6) AS median, CAST(max(value) AS BIGINT) AS max, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS active_frac FROM fl GROUP BY 1, 2")(lambda s, d: reports.channel_summary(ad.frames(s, d)))
add("a11_noise_stats", f"""WITH {F_}, {_flong}, s AS (SELECT session_id, sensor, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx FROM fl GROUP BY 1, 2)
SELECT s.session_id, CAST(s.sensor AS BIGINT) AS sensor, min(s.n) AS n, round(min(mean), 6) AS mean, round(min(sd), 6) AS sd, CAST(min(mn) AS BIGINT) AS min, CAST(min(mx) AS BIGINT) AS max, CAST(min(mx) - min(mn) AS BIGINT) AS p2p, count(*) FILTER (WHERE sd > 0 AND abs(value - mean) > 2.5 * sd) AS n_far
FROM s JOIN fl ON fl.session_id = s.session_id AND fl.sensor = s.sensor GROUP BY s.session_id, s.sensor""")(lambda s, d: reports.noise_stats(ad.frames(s, d), 2.5))
add("a12_ceiling_fraction", f"WITH {F_} SELECT session_id, {', '.join(f'round(avg(CASE WHEN s{i} > 824 THEN 1.0 ELSE 0.0 END), 6) AS above_s{i}' for i in range(6))}, round(avg(CASE WHEN greatest(s0, s1, s2, s3, s4, s5) > 824 THEN 1.0 ELSE 0.0 END), 6) AS above_any FROM frames GROUP BY session_id")(lambda s, d: reports.ceiling_fraction(ad.frames(s, d)))
add("a12_zero_fraction", f"WITH {F_} SELECT session_id, {', '.join(f'round(avg(CASE WHEN s{i} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_s{i}' for i in range(6))} FROM frames GROUP BY session_id")(lambda s, d: reports.zero_fraction(ad.frames(s, d)))
add("a14_force_distribution", f"WITH {F_} SELECT session_id, CAST(min(total) AS BIGINT) AS min, round(quantile_cont(total, 0.05), 6) AS p05, round(median(total), 6) AS median, round(quantile_cont(total, 0.95), 6) AS p95, CAST(max(total) AS BIGINT) AS max, round(avg(CASE WHEN total >= 1200 THEN 1.0 ELSE 0.0 END), 6) AS on_frac FROM frames GROUP BY session_id")(lambda s, d: reports.force_distribution(ad.frames(s, d)))
add("a15_run_length_report", f"""WITH {F_}, {RUNS} SELECT session_id, count(*) AS n_runs, min(n_frames) AS min, round(median(n_frames), 6) AS median, round(quantile_cont(n_frames, 0.9), 6) AS p90, max(n_frames) AS max, count(*) FILTER (WHERE n_frames > 200) AS n_over, count(*) FILTER (WHERE n_frames < 15) AS n_under,
(SELECT count(*) FROM stances s WHERE s.session_id = runs.session_id) AS n_stances, (SELECT count(*) FROM merged m WHERE m.session_id = runs.session_id) AS n_merged FROM runs GROUP BY session_id""")(
    lambda s, d: reports.run_length_report(st.find_runs(fr(s, d)), st.find_stances(fr(s, d)), st.merge_close(st.find_stances(fr(s, d))), 15, 200)
)
add("a16_dt_drift", f"""WITH {features_sql()} SELECT m.session_id, max(m.n_frames) AS longest, round(max(abs((m."end" - m.start) * d.dt_s - (b.ts_us - a.ts_us) / 1e6)), 6) AS worst_drift_s FROM merged m JOIN dts d USING (session_id)
JOIN frames a ON a.session_id = m.session_id AND a.frame_idx = m.start JOIN frames b ON b.session_id = m.session_id AND b.frame_idx = m."end" GROUP BY m.session_id""")(
    lambda s, d: reports.dt_drift(timed_stances(s, d), st.frame_dt(ad.frames(s, d)))
)
_spread = lambda tbl: f"""WITH {features_sql()}, per AS (SELECT label, session_id, stance, avg(cx) * 274.0 AS ml FROM {tbl} GROUP BY 1, 2, 3) SELECT label, round(stddev_samp(ml), 6) AS sd_mm, round(max(ml) - min(ml), 6) AS range_mm, count(ml) AS n FROM per GROUP BY label"""
add("a21_ml_spread", _spread("loaded"))(lambda s, d: reports.ml_spread(inside(s, d)))
add("j1_compare_captures", f"""WITH {F_}, b AS (SELECT * REPLACE (CASE WHEN l_partkey % 89 = 0 THEN s3 + 1 ELSE s3 END AS s3) FROM frames WHERE l_orderkey % 97 <> 0)
SELECT f.session_id, count(*) AS n_a, count(b.seq) AS n_both, {', '.join(f'count(*) FILTER (WHERE b.seq IS NOT NULL AND f.{c} IS DISTINCT FROM b.{c}) AS diff_{c}' for c in ['ts_us', *CH])}, count(b.seq) AS n_b, round(100.0 * count(b.seq) / count(*), 6) AS coverage_pct
FROM frames f LEFT JOIN b ON f.session_id = b.session_id AND f.seq = b.seq GROUP BY f.session_id""")(
    lambda s, d: matching.compare_captures(ad.frames(s, d), ad.frames(s, d).filter("l_orderkey % 97 <> 0").withColumn("s3", F.expr("CASE WHEN l_partkey % 89 = 0 THEN s3 + 1 ELSE s3 END")))
)
# islands by number, so that all joins are on equal keys
_b = lambda s, d: ad.frames(s, d).filter("l_orderkey % 97 <> 0").withColumn("s3", F.expr("CASE WHEN l_partkey % 89 = 0 THEN s3 + 1 ELSE s3 END"))
_bsql = "b AS (SELECT * REPLACE (CASE WHEN l_partkey % 89 = 0 THEN s3 + 1 ELSE s3 END AS s3) FROM frames WHERE l_orderkey % 97 <> 0 AND session_id % 5 <> 0)"
add("j1_verdict", f"""WITH {F_}, {_bsql}, j AS (SELECT f.session_id, count(b.seq) AS n_both, count(*) FILTER (WHERE b.seq IS NOT NULL AND f.s3 <> b.s3) AS n FROM frames f LEFT JOIN b ON f.session_id = b.session_id AND f.seq = b.seq GROUP BY f.session_id)
SELECT session_id, n_both, CASE WHEN n_both = 0 THEN 'no_overlap' WHEN n > 0 THEN 'mismatch' ELSE 'same' END AS verdict FROM j""")(
    lambda s, d: matching.comparison_verdict(matching.compare_captures(ad.frames(s, d), _b(s, d).filter("session_id % 5 <> 0"))).select("session_id", "n_both", "verdict")
)
add("j1_first_mismatches", f"""WITH {F_}, {_bsql}, j AS (SELECT f.session_id, f.seq, f.s3, b.s3 AS s3_b, row_number() OVER (PARTITION BY f.session_id ORDER BY f.seq) AS place FROM frames f JOIN b ON f.session_id = b.session_id AND f.seq = b.seq WHERE f.s3 <> b.s3)
SELECT session_id, CAST(seq AS BIGINT) AS seq, CAST(s3 AS BIGINT) AS s3, CAST(s3_b AS BIGINT) AS s3_b, place FROM j WHERE place <= 10""")(
    lambda s, d: matching.first_mismatches(ad.frames(s, d), _b(s, d).filter("session_id % 5 <> 0")).select("session_id", "seq", "s3", "s3_b", "place")
)
add("j2_frames_in_stances", f"""WITH {F_}, {RUNS}, kept AS (SELECT session_id, run, min(frame_idx) AS s, max(frame_idx) AS e FROM numbered WHERE on_ = 1 GROUP BY session_id, run HAVING count(*) BETWEEN 15 AND 200),
ko AS (SELECT *, CASE WHEN coalesce(s - lag(e) OVER (PARTITION BY session_id ORDER BY s) - 1 >= 12, true) THEN 1 ELSE 0 END AS opens FROM kept), ki AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY s) - 1 AS stance FROM ko),
ks AS (SELECT session_id, run, stance, min(s) OVER (PARTITION BY session_id, stance) AS start, max(e) OVER (PARTITION BY session_id, stance) AS "end" FROM ki),
fw AS (SELECT n.session_id, n.frame_idx, last_value(k.stance IGNORE NULLS) OVER w AS stance, last_value(k.start IGNORE NULLS) OVER w AS start, last_value(k."end" IGNORE NULLS) OVER w AS "end" FROM numbered n LEFT JOIN ks k ON k.session_id = n.session_id AND k.run = n.run
  WINDOW w AS (PARTITION BY n.session_id ORDER BY n.frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, CAST(stance AS BIGINT) AS stance, frame_idx, start, "end" FROM fw WHERE frame_idx BETWEEN start AND "end" """)(
    lambda s, d: st.frames_in_stances(fr(s, d)).select("session_id", "stance", "frame_idx", "start", "end")
)
# the greedy claims of a session's detections, one after the other, with the list of what is claimed
MATCHES = f"""{F_}, {RUNS}, lasts AS (SELECT session_id, label, max(frame_idx) AS last, CASE label WHEN 'walk' THEN 100 WHEN 'fast' THEN 60 ELSE 50 END AS p FROM frames WHERE label <> 'stand' GROUP BY session_id, label),
truth AS (SELECT session_id, i, i * p AS start, i * p + p * 6 // 10 AS "end" FROM (SELECT session_id, p, unnest(range(last // p + 1)) AS i FROM lasts)),
det AS (SELECT session_id, start, "end", row_number() OVER (PARTITION BY session_id ORDER BY start) AS k FROM merged),
both_ AS (SELECT d.session_id, d.k, t.i, t.start, least(d."end", t."end") - greatest(d.start, t.start) + 1 AS n, t."end" - t.start + 1 AS size FROM det d JOIN truth t ON t.session_id = d.session_id AND t.start <= d."end" AND d.start <= t."end"),
cand AS (SELECT d.session_id, d.k, coalesce(c.c, []) AS c FROM det d LEFT JOIN (SELECT session_id, k, list(i ORDER BY n DESC, start) AS c FROM both_ WHERE n >= {{share}} * size GROUP BY session_id, k) c ON c.session_id = d.session_id AND c.k = d.k),
claims AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS pick FROM det UNION ALL
  SELECT session_id, k, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END, pick FROM (SELECT r.session_id, c.k, r.claimed, list_filter(c.c, lambda x: NOT list_contains(r.claimed, x))[1] AS pick FROM claims r JOIN cand c ON c.session_id = r.session_id AND c.k = r.k + 1)),
matched AS (SELECT d.session_id, d.start, d."end", t.start AS t_start, t."end" AS t_end FROM claims c JOIN det d ON d.session_id = c.session_id AND d.k = c.k JOIN truth t ON t.session_id = c.session_id AND t.i = c.pick)"""
add("j3_boundary_report", f"""WITH RECURSIVE {MATCHES.format(share=0)} SELECT session_id, count(*) AS n_matched, round(avg(start - t_start), 6) AS start_offset, round(avg("end" - t_end), 6) AS end_offset, round(avg(("end" - t_end) - (start - t_start)), 6) AS duration_error FROM matched GROUP BY session_id""")(lambda s, d: matching.boundary_report(st.merge_close(st.find_stances(fr(s, d))), truth(s, d)))
add("j4_scorecard", f"""WITH RECURSIVE {MATCHES.format(share=0.5)}, n AS (SELECT session_id, sum(d) AS d, sum(t) AS t, sum(m) AS tp FROM (SELECT session_id, 1 AS d, 0 AS t, 0 AS m FROM det UNION ALL SELECT session_id, 0, 1, 0 FROM truth UNION ALL SELECT session_id, 0, 0, 1 FROM matched) GROUP BY session_id)
SELECT session_id, CAST(tp AS BIGINT) AS tp, CAST(d - tp AS BIGINT) AS fp, CAST(t - tp AS BIGINT) AS fn, round(tp / nullif(d, 0), 6) AS precision, round(tp / nullif(t, 0), 6) AS recall, round(2 * tp / nullif(d + t, 0), 6) AS f1 FROM n""")(lambda s, d: matching.scorecard(st.merge_close(st.find_stances(fr(s, d))), truth(s, d)))
_pins = "SELECT session_id, 7 + session_id % 3 AS pinned FROM (SELECT DISTINCT session_id FROM frames) WHERE session_id % 4 <> 1"
add("j5_pinned_counts", f"WITH {F_}, {RUNS}, c AS (SELECT session_id, count(*) AS n_stances FROM merged GROUP BY session_id), p AS ({_pins}) SELECT session_id, n_stances, pinned, CASE WHEN pinned IS NULL THEN 'no_pin' ELSE 'mismatch' END AS state FROM c LEFT JOIN p USING (session_id) WHERE pinned IS NULL OR pinned <> n_stances")(
    lambda s, d: matching.pinned_counts(
        st.merge_close(st.find_stances(fr(s, d))).groupBy("session_id").agg(F.count("*").alias("n_stances")),
        ad.frames(s, d).select("session_id").distinct().filter("session_id % 4 <> 1").withColumn("pinned", 7 + F.col("session_id") % 3),
    )
)
add("j8_threshold_sweep", f"""WITH {F_}, {RUNS}, c AS (SELECT unnest([30, 60, 120, 200]) AS max_duration), k AS (SELECT r.*, c.max_duration FROM runs r, c WHERE n_frames BETWEEN 15 AND c.max_duration),
ko AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY session_id, max_duration ORDER BY start) - 1 >= 12, true) THEN 1 ELSE 0 END AS o2 FROM k)
SELECT session_id, CAST(max_duration AS BIGINT) AS max_duration, CAST(sum(o2) AS BIGINT) AS n_stances FROM ko GROUP BY 1, 2""")(lambda s, d: st.threshold_sweep(fr(s, d), [30, 60, 120, 200]))
add("o3_longest_stance", f'WITH {F_}, {RUNS} SELECT session_id, max(n_frames) AS longest, arg_max(start, n_frames * 1000000 - start) AS start FROM merged GROUP BY session_id')(
    lambda s, d: st.merge_close(st.find_stances(fr(s, d))).groupBy("session_id").agg(F.max("n_frames").alias("longest"), F.max_by("start", F.struct("n_frames", -F.col("start"))).alias("start"))
)
add("o7_frame_budget", f"WITH {F_} SELECT session_id, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM frames WHERE frame_idx < 200 GROUP BY session_id")(
    lambda s, d: fr(s, d).withColumn("place", F.row_number().over(link.by_session("frame_idx"))).filter("place <= 200").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
)
add("a13_calibration_ceiling", f"WITH {F_} SELECT CAST(max(greatest(s0, s1, s2, s3, s4, s5)) AS BIGINT) AS ceiling FROM frames")(lambda s, d: __import__("strideforge.operators.calibration", fromlist=["x"]).calibration_ceiling(ad.frames(s, d)))

