"""Folds in their tens of thousands, none of which passes through the driver; subtraction against fits on the rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideforge.operators import evaluate as ev
from strideforge.operators import leave_out, models

X = ["x0", "x1"]


def points(spark, n, shift=0.0):
    """Two classes around points that lie far from zero if shift is large."""
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(100_003)) / 100_003.0 - 0.5) * 3
    k = F.col("id") % 2
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.when(k == 0, "a").otherwise("b").alias("label"), F.concat(F.lit("s"), F.col("id") % 7).alias("session"),
        (u(1) + k + shift).alias("x0"), (u(2) - k + shift).alias("x1"),
    )


def by_hand(x, y, test, train, kind):
    classes, scores = sorted(set(y)), []
    n = len(train)
    means = {c: x[train][y[train] == c].mean(0) for c in classes}
    scatter = {c: (x[train][y[train] == c] - means[c]).T @ (x[train][y[train] == c] - means[c]) for c in classes}
    size = {c: (y[train] == c).sum() for c in classes}
    for c in classes:
        cov = sum(scatter.values()) / (n - len(classes)) if kind == "lda" else scatter[c] / (size[c] - 1)
        d = x[test] - means[c]
        scores.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(size[c] / n))
    return np.array(classes)[np.argmax(scores, 0)]


@pytest.mark.parametrize("kind", ["lda", "qda"])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_subtraction_equals_a_fit_on_the_rest(spark, kind, shift):
    rows = points(spark, 900, shift).withColumn("fold", F.when(F.col("row_id") % 10 < 8, F.col("row_id") % 6))
    got = {r.row_id: r for r in ev.evaluate_held_out(rows, X, kind)[0].collect()}
    all_rows = rows.orderBy("row_id").collect()
    x, y = np.array([[r.x0, r.x1] for r in all_rows]), np.array([r.label for r in all_rows])
    fold = np.array([-1 if r.fold is None else r.fold for r in all_rows])
    assert len(got) == (fold >= 0).sum()
    for f in range(6):
        test = np.flatnonzero(fold == f)
        assert [got[i].pred for i in test] == by_hand(x, y, test, np.flatnonzero(fold != f), kind).tolist()


def test_a_hundred_thousand_folds(spark, monkeypatch):
    """Every row is a fold of its own; what the driver collects is a row for each class."""
    n, collected = 100_000, []
    rows = points(spark, n).withColumn("fold", F.col("row_id")).cache()
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: collected.append(got := collect(df)) or got)
    predicted, fits = ev.evaluate_held_out(rows, X, "lda")
    table = predicted.agg(F.count("*").alias("n"), F.count("pred").alias("known"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
    some = predicted.filter("row_id % 9973 = 0")
    monkeypatch.undo()
    assert all(len(c) <= 2 for c in collected) and collected
    t = table.first()
    assert (t.n, t.known) == (n, n) and 0.7 < t.accuracy < 0.9
    assert fits.filter("reason is not null").count() == 0
    all_rows = rows.orderBy("row_id").toPandas()
    x, y = all_rows[X].to_numpy(), all_rows.label.to_numpy(str)
    for r in some.collect():
        assert r.pred == by_hand(x, y, [r.row_id], np.flatnonzero(np.arange(n) != r.row_id), "lda")[0]


def test_folds_that_cannot_be_fitted_say_why(spark):
    rows = points(spark, 12).withColumn("fold", F.when(F.col("label") == "b", 0).otherwise(1))
    predicted, fits = ev.evaluate_held_out(rows.filter("row_id < 8"), X, "qda")
    assert predicted.count() == 8
    few = points(spark, 6).withColumn("fold", F.col("row_id") % 3)
    predicted, fits = ev.evaluate_held_out(few, X, "qda")
    assert {r.reason for r in fits.collect()} == {"class a has 2 rows, too few for 2 features"}
    assert [r.pred for r in predicted.collect()] == [None] * 6
    assert ev.evaluate_held_out(few.limit(0), X)[0].count() == 0


def test_fit_without_subtracts(spark):
    rows = points(spark, 300, 50.0).withColumn("fold", (F.col("row_id") % 4).cast("int"))
    stats = models.class_stats(rows, X, "label", ["fold"]).collect()
    for f, m in models.fit_without(stats, 2, "qda")[0].items():
        want = models.fit(rows.filter(F.col("fold") != f), X)
        assert np.allclose(m["means"], want["means"]) and np.allclose(m["covs"], want["covs"]) and m["counts"] == want["counts"]
    assert leave_out.fold_stats(rows, X)[0].count() == 4
