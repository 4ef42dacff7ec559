"""Percentiles, running medians, families of tests and files of any size, against plain computations."""

import hashlib
import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideforge.operators import evaluate as ev
from strideforge.operators import reports
from strideforge.operators import stances as st
from strideforge.operators.quantiles import exact_percentiles, from_bits, ordered_bits
from strideforge.sources.documents import fingerprint

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), math.pi, -math.pi, 1e-9]


def test_bits_have_the_order_of_doubles(spark):
    rnd = random.Random(1)
    values = ODD + [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-300, 300) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).select("v", "b", from_bits(F.col("b")).alias("w")).collect()
    assert all(r.v == r.w for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.b)] == sorted(r.v for r in rows)


def test_exact_percentiles_equal_numpy(spark):
    rnd = random.Random(2)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 50, "near": [1 + k * 2**-52 for k in range(30)], None: [rnd.gauss(0, 1) for _ in range(501)]}
    groups["wide"] = [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-200, 200) for _ in range(400)]
    rows = [(k, v) for k, x in groups.items() for v in x] + [("one", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "p05": 0.05, "median": 0.5, "p9": 0.9, "high": 1.0}
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(float(np.quantile(x, q)), rel=1e-12), (g, name)
    assert exact_percentiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_a_label_with_all_rows(spark):
    df = spark.range(300_000).select(F.lit("all").alias("label"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("x0"))
    row = reports.describe_features(df, ["x0"], refined=True).first()
    want = reports.describe_features(df, ["x0"]).first()
    assert row.median == want.median and row.n == want.n


def test_running_median_equals_the_plain_one():
    rnd = random.Random(3)
    for kinds in (1, 2, 5, 10_000):
        m, x = st.RunningMedian(), []
        for _ in range(400):
            v = rnd.randrange(-kinds, kinds + 1)
            m.add(v)
            x.append(v)
            assert m.median() == statistics.median(x)
    m, began = st.RunningMedian(), time.process_time()
    for v in range(10_000):
        for _ in range(20):
            m.add((v * 7919) % 10_007)
    assert m.n == 200_000 and time.process_time() - began < 5


def test_running_dt(spark):
    rnd, rows = random.Random(4), []
    for s in ("a", "b"):
        for e in (0, 1):
            t = 0
            for i in range(rnd.randrange(1, 60)):
                t += rnd.randrange(9000, 11000)
                rows.append((s, e, i, t))
    df = spark.createDataFrame(rows, "session_id string, epoch int, frame_idx long, ts_us long")
    got = {(r.session_id, r.epoch, r.frame_idx): r.dt_s for r in st.running_dt(df).collect()}
    for s, e, i, t in rows:
        ts = [r[3] for r in rows if r[:2] == (s, e) and r[2] <= i]
        assert got[s, e, i] == (None if i == 0 else statistics.median([b - a for a, b in zip(ts, ts[1:])]) / 1e6)


def test_holm_over_ranges_equals_the_step_down(spark):
    rnd = random.Random(5)
    p = [rnd.choice([rnd.random() / 500, rnd.random(), 0.01, 0.0]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(9999, None)], "id long, p double").repartition(6)
    got = {r.id: r.p_holm for r in ev.holm(df).collect()}
    order, most = sorted(range(len(p)), key=lambda i: (p[i], i)), 0.0
    for r, i in enumerate(order):
        most = max(most, (len(p) - r) * p[i])
        assert got[i] == pytest.approx(min(most, 1.0), rel=1e-12)
    assert got[9999] is None and len(got) == 3001
    assert "SinglePartition" not in ev.holm(df)._jdf.queryExecution().executedPlan().toString()
    assert ev.holm(df.limit(0)).count() == 0


def test_digests_of_files_in_pieces(spark, tmp_path):
    data = {f"f{n}.bin": random.Random(n).randbytes(n) for n in (1, 1000, 4096, 300_001)}
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    for whole, piece in ((1 << 20, 1 << 20), (1000, 4096), (-1, 7001)):
        assert {r.name: r.sha256 for r in fingerprint(spark, str(tmp_path), whole, piece).collect()} == {k: hashlib.sha256(x).hexdigest() for k, x in data.items()}
