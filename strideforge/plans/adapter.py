"""Sensor tables derived from the given tables, by integer arithmetic only: the same text serves Spark and DuckDB.

lineitem gives sessions (supplier) of ordered frames with six channels, and text lines with planted faults; events gives an
arrival stream; embeddings gives labelled feature rows; part gives calibration trials.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.operators.store import written
from strideforge.schemas import CHANNELS, FEATURES

# Values of the made-up sessions: when each channel is loaded (per cent of a step), how much, and the loads of standing.
WINDOWS = [(0, 28), (12, 44), (28, 52), (30, 56), (36, 60), (46, 64)]
AMPLITUDES = [3000, 1500, 2500, 2700, 2300, 1900]
STANDING = [1700, 950, 1150, 1350, 1050, 450]
ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
GAINS = {0: 1.02, 1: 0.95, 2: 0.98, 3: 1.21, 4: 0.88, 5: 0.96}


LABEL = "CASE kind WHEN 0 THEN 'walk' WHEN 1 THEN 'fast' WHEN 2 THEN 'shuffle' ELSE 'stand' END"
KIND = "CASE WHEN session_id % 10 = 9 THEN 3 ELSE session_id % 3 END"
REPRESENTATIONS = ("raw", "conductance", "gain_matched")


def _channel(i, div):
    a, b = WINDOWS[i]
    amp = AMPLITUDES[i]
    pulse = f"{div(f'(CASE WHEN kind = 2 THEN {amp * 45 // 100} ELSE {amp} END) * 2 * least(ph - {a}, {b} - ph)', b - a)}"
    moving = f"(CASE WHEN ph >= {a} AND ph < {b} THEN {pulse} ELSE 0 END) + (CASE WHEN l_linenumber > 2 THEN (nz * {i + 3}) % 25 ELSE 0 END)"
    return f"CAST(CASE WHEN kind = 3 THEN {STANDING[i]} + nz WHEN (l_partkey * 31 + k) % 211 = 0 THEN 0 ELSE {moving} END AS INT) AS s{i}"


def frame_columns(div):
    return [
        "session_id", "k AS frame_idx",
        f"{LABEL} AS label",
        "CAST(k % 65536 AS INT) AS seq", "CAST(k * 10000 + (l_orderkey % 3 - 1) AS BIGINT) AS ts_us",
        *[_channel(i, div) for i in range(6)], "l_orderkey", "l_partkey",
    ]


BASE = ["l_suppkey AS session_id", "k", "l_orderkey", "l_partkey", "l_linenumber", "CASE WHEN l_suppkey % 10 = 9 THEN 3 ELSE l_suppkey % 3 END AS kind", "(l_partkey * 7 + l_orderkey) % 25 AS nz"]


def phase(div):
    return f"{div('(k % (CASE kind WHEN 0 THEN 100 WHEN 1 THEN 60 ELSE 50 END)) * 100', '(CASE kind WHEN 0 THEN 100 WHEN 1 THEN 60 ELSE 50 END)')} AS ph"


def spark_div(a, b):
    return f"(({a}) div {b})"


def duck_div(a, b):
    return f"(({a}) // {b})"


#: Rows of sensor frames that a task orders. Beyond it tables are dealt to as many tasks as that asks for: left to itself adaptive
#: execution joins partitions up to its advisory size, which is millions of frames. It is small enough for tables of a few million
#: frames to have whole tasks already: a task of a larger table is no larger. Beyond 200 tasks (40 million frames) Spark also orders
#: what a reader deals out, a split of the file, which spark.sql.files.maxPartitionBytes bounds.
TASK_ROWS = 200_000


def dealt(rows, key):
    """rows dealt by key to tasks of about TASK_ROWS rows, so that what a task orders does not grow with the table."""
    n = rows.count()
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), key)


def once(rows, name):
    """rows by session, written once for what several parts of a query read."""
    return dealt(written(rows, name), "session_id")


def frames(spark, sf_dir):
    """Frames of the lineitem sessions, with label and the keys that plant faults; one exchange on the session."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    w = Window.partitionBy("l_suppkey").orderBy(*ORDER.split(", "))
    rows = dealt(li, "l_suppkey").withColumn("k", (F.row_number().over(w) - 1).cast("bigint")).selectExpr(*BASE).selectExpr("*", phase(spark_div))
    return rows.selectExpr(*frame_columns(spark_div))


FRAMES_SQL = f"""
base AS (
  SELECT {', '.join(BASE)} FROM (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS k FROM lineitem)
), phased AS (SELECT *, {phase(duck_div)} FROM base),
frames AS (SELECT {', '.join(frame_columns(duck_div))}, s0 + s1 + s2 + s3 + s4 + s5 AS total FROM phased)"""

# The lines: restarts, dropped frames, wrong checksums, junk, status lines.
RESTARTED = "(session_id % 10 = 7 AND frame_idx >= 300)"
SEQ = f"CASE WHEN {RESTARTED} THEN frame_idx - 300 ELSE frame_idx END"
TS = f"CASE WHEN {RESTARTED} THEN ts_us - 3000000 ELSE ts_us END"
SUM = f"({SEQ}) + ({TS}) + s0 + s1 + s2 + s3 + s4 + s5"
CHECK = f"(({SUM}) % 256 + 256 + CASE WHEN l_partkey % 89 = 0 THEN 1 ELSE 0 END) % 256"
FRAME_LINE = f"concat_ws(',', 'INS', CAST({SEQ} AS STRING), CAST({TS} AS STRING), CAST(s0 AS STRING), CAST(s1 AS STRING), CAST(s2 AS STRING), CAST(s3 AS STRING), CAST(s4 AS STRING), CAST(s5 AS STRING), CAST({CHECK} AS STRING))"
LINE_PARTS = [
    ("0", FRAME_LINE, "l_orderkey % 97 <> 0"),
    ("1", "CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'noise,1,2' END", "l_partkey % 401 = 0"),
    ("2", "concat('# ble conn=0 mtu=0 notif=', CAST(frame_idx AS STRING))", "frame_idx % 100 = 99"),
]


def lines(spark, sf_dir):
    f = frames(spark, sf_dir)
    cells = ", ".join(f"CASE WHEN {cond} THEN named_struct('n', frame_idx * 4 + {n}, 'v', {value}) END" for n, value, cond in LINE_PARTS)
    rows = f.selectExpr("session_id", f"explode(filter(array({cells}), x -> x is not null)) AS x")
    return rows.selectExpr("session_id", "x.n AS line_no", "x.v AS value")


LINES_SQL = "lines AS (" + " UNION ALL ".join(f"SELECT session_id, frame_idx * 4 + {n} AS line_no, {value} AS value FROM frames WHERE {cond}" for n, value, cond in LINE_PARTS) + ")"


def features(spark, sf_dir, p=2):
    """Labelled rows of the embeddings: row_id, label, session, start, x0..x<p-1>."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.selectExpr(
        "vec_id AS row_id", "CAST(label AS STRING) AS label", "concat(CAST(label AS STRING), '_', CAST(vec_id % 4 AS STRING)) AS session", "vec_id AS start",
        *[f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(p)],
    )


def features_sql(p=2):
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(p))
    return f"feats AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, label || '_' || (vec_id % 4) AS session, vec_id AS start, {cols} FROM embeddings)"


def stances(spark, sf_dir):
    """Features of the moving sessions' stances under every representation: rep, row_id, label, session, start, features."""
    from strideforge.operators.features import represented, stance_features, stance_frames

    out = None
    f = stance_frames(frames(spark, sf_dir).filter("label <> 'stand'"))
    # detection is on raw counts, so it is the same for all: its frames are written once
    inside = once(f.select("session_id", "stance", "start", "end", "frame_idx", "ts_us", "dt_s", *CHANNELS), "inside")
    for rep in REPRESENTATIONS:
        part = stance_features(represented(inside, rep, GAINS)).selectExpr(
            f"'{rep}' AS rep", "session_id * 100000 + stance AS row_id", f"{LABEL.replace('kind', f'({KIND})')} AS label", "CAST(session_id AS STRING) AS session", "start", "s4_zero_frac", *FEATURES
        )
        out = part if out is None else out.unionByName(part)
    return out


TRIAL_COLUMNS = [
    "CAST(p_partkey % 6 AS INT) AS sensor", "CAST(p_partkey AS BIGINT) AS trial", "CAST((p_partkey * 37) % 4096 AS INT) AS count",
    "CAST((p_partkey * 37) % 4096 AS DOUBLE) / 400.0 + CAST(p_partkey % 7 AS DOUBLE) / 10.0 AS force_n", "CAST(p_partkey % 6 AS DOUBLE) * 100.0 AS g_min",
    "CAST(p_partkey % 6 AS DOUBLE) * 100.0 + CAST(p_partkey % 5 AS DOUBLE) AS g_max",
]


def trials(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*TRIAL_COLUMNS)


TRIALS_SQL = f"trials AS (SELECT {', '.join(TRIAL_COLUMNS)} FROM part)"


def arrivals(spark, sf_dir):
    """Arrival-stamped rows: session (user), arrival time, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("user_id AS session_id", "CAST(ts AS TIMESTAMP) AS arrival_ts", "event_id AS line_no", "CAST(value AS STRING) AS value")
