"""The grid: frames are ordered once for all representations, and a Newton step adds up what a task holds before it leaves it."""

import numpy as np
from pyspark.sql import functions as F

from strideforge.operators import logistic
from strideforge.plans import adapter as ad


def test_packed_sums_in_another_scale_are_step_sums():
    rnd = np.random.default_rng(5)
    n, p, k = 300, 4, 3
    x, y, of = rnd.normal(3, 2, (n, p)), rnd.integers(0, k, n), rnd.integers(0, 2, n).astype(bool)
    near, far = (x[of].mean(0), x[of].std(0)), (x.mean(0), x.std(0))
    w = rnd.normal(size=(k, p + 1))
    told = logistic.step_sums(np.column_stack([np.ones(of.sum()), (x[of] - near[0]) / near[1]]), y[of], w)
    turn = logistic.turned(*near, far)
    u = np.column_stack([np.ones(n), (x - far[0]) / far[1]])
    i, j = np.triu_indices(p + 1)
    packed = logistic.packed_sums(u, u[:, i] * u[:, j], y, w @ turn, of.astype(float))
    assert np.allclose(logistic.unpacked_sums(packed, k, p + 1, turn), told, atol=1e-9)


def test_representations_share_one_pass_over_the_frames(spark, monkeypatch):
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    i = F.col("id")
    load = F.when(i % 100 < 50, 400 + i % 7).otherwise(0).cast("int")
    rows = spark.range(600).select(F.lit(1).cast("long").alias("session_id"), F.lit("fast").alias("label"), i.alias("frame_idx"), (i * 10_000).alias("ts_us"), *[load.alias(f"s{c}") for c in range(6)])
    monkeypatch.setattr(ad, "frames", lambda spark, d: rows.mapInArrow(counted, rows.schema))
    found = ad.stances(spark, None).groupBy("rep").count().collect()
    assert {r.rep: r["count"] for r in found} == {rep: 6 for rep in ad.REPRESENTATIONS}
    assert passes.value == 600
