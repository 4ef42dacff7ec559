"""What grows with the tables: rows of a task, and how often a query reads its frames."""

import numpy as np
from pyspark.sql import functions as F

from strideforge.functions import frames as fx
from strideforge.operators import features as ft
from strideforge.operators import segments
from strideforge.operators.quantiles import exact_percentiles
from strideforge.plans import adapter as ad
from strideforge.plans import frame_queries as fq
from strideforge.schemas import CHANNELS


def test_tables_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ad, "TASK_ROWS", 500)
    rows = spark.range(10_000).withColumn("session_id", F.col("id") % 1000)
    tasks = ad.dealt(rows, "session_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 16 and max(r["count"] for r in tasks) < 1000
    assert ad.dealt(rows.limit(400), "session_id").count() == 400


def test_tasks_of_small_and_large_tables_are_alike(spark):
    """With 12 partitions, as on 0.1 GB of tables: 3.6 million frames have whole tasks already, five times as many have no larger ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        most = []
        for n in (3_600_000, 18_000_000):
            rows = spark.range(n).select((F.col("id") % (n // 600)).alias("session_id"))
            most.append(ad.dealt(rows, "session_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(most) < 250_000 and most[1] < 1.15 * most[0]


def test_percentiles_of_small_and_large_groups_together(spark):
    rnd = np.random.default_rng(3)
    data = {"few": rnd.normal(size=7), "many": rnd.normal(size=400), None: rnd.normal(size=300)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("none", None)], "g string, v double")
    shares = {"a": 0.05, "b": 0.5, "c": 0.95}
    for small in (0, 100, 350, 1000):
        got = {r.g: r for r in exact_percentiles(df, ["g"], "v", shares, small=small).collect()}
        assert got.keys() == data.keys()
        for g, vs in data.items():
            assert np.allclose([got[g][k] for k in shares], [np.quantile(vs, q) for q in shares.values()], atol=1e-12), (small, g)
        whole = exact_percentiles(df, [], "v", shares, small=small).collect()
        assert len(whole) == 1 and np.isclose(whole[0].b, np.median(np.concatenate(list(data.values()))))


def test_events_of_segments_read_their_frames_twice(spark):
    """Once for the runs and once for the last epochs of the sessions: the steps after them read what was written."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    rows = spark.range(600).select(F.lit("a").alias("session_id"), F.lit(0).alias("epoch"), F.col("id").alias("frame_idx"), F.when(F.col("id") % 100 < 50, 2000).otherwise(0).alias("total"))
    frames = rows.mapInArrow(counted, rows.schema)
    assert segments.stance_events(frames, size=97).count() > 0
    assert passes.value <= 2 * 600


def test_predictions_order_their_frames_once(spark):
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    i = F.col("id")
    load = F.when(i % 100 < 50, 400 + (i * 7) % 11).otherwise(0).cast("int")
    session = F.when(i < 600, 1).cast("long")  # the rest has none, and no row in the result
    gap = F.when(i % 100 == 0, 5).when(i % 100 == 20, 3).otherwise(0).cast("long")
    rows = spark.range(900).select(session.alias("session_id"), F.lit(0).alias("epoch"), i.alias("frame_idx"), (i * 10_000).alias("ts_us"), gap.alias("last_gap"), *[load.alias(c) for c in CHANNELS])
    rows = rows.withColumn("total", fx.total_force())
    found = fq.predictions(rows.mapInArrow(counted, rows.schema)).collect()
    assert passes.value == 900
    assert [(r.session_id, r.start, r.end, r.gap_frames) for r in sorted(found, key=lambda r: r.start)] == [(1, 100 * k, 100 * k + 49, 3) for k in range(6)]
    assert found[0].asDict().keys() >= {"cop_path_len", "impulse_counts_s", "pred"}


def test_activation_timing_turns_stances_to_rows_of_sensors_not_frames(spark, monkeypatch):
    turned = spark.sparkContext.accumulator(0)
    plain = ft.unpivoted

    def counted(rows, keep):
        def run(batches):
            for batch in batches:
                turned.add(batch.num_rows)
                yield batch

        return plain(rows.mapInArrow(run, rows.schema), keep)

    rnd = np.random.default_rng(7)
    n, stances, every = 2000, 40, 50
    values = rnd.integers(-3, 9, (n, len(CHANNELS)))
    values[:, 5] = 0
    rows = [(1, k // every, k // every * every, (k // every + 1) * every - 1, k, 0.01, *[None if v < -2 else int(v) for v in values[k]]) for k in range(n)]
    inside = spark.createDataFrame(rows, "session_id long, stance int, start long, end long, frame_idx long, dt_s double, " + ", ".join(f"{c} int" for c in CHANNELS))
    monkeypatch.setattr(ft, "unpivoted", counted)
    got = {r.sensor: r for r in ft.activation_timing(inside).collect()}
    assert turned.value == stances
    assert got.keys() == {0, 1, 2, 3, 4}
    for i in got:
        onsets, peaks = [], []
        for s in range(stances):
            v = [r[6 + i] for r in rows[s * every : (s + 1) * every - 1]]
            top = max(x for x in v if x is not None)
            onsets.append(next(k for k, x in enumerate(v) if x is not None and x >= 0.2 * top) * 0.01)
            peaks.append(v.index(top) * 0.01)
        want = [np.mean(onsets), np.std(onsets), np.mean(peaks), np.std(peaks), stances]
        assert np.allclose([got[i][c] for c in ("onset_mean_s", "onset_sd_s", "peak_mean_s", "peak_sd_s", "n")], want, atol=1e-12)
