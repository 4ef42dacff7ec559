import datetime as dt

import numpy as np
import pytest

from strideforge.operators import calibration as cal
from strideforge.operators import evaluate as ev
from strideforge.operators import matching, models, splits
from strideforge.sources import documents, logs

X = ["x0", "x1"]


@pytest.fixture(scope="module")
def gaussian(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label, n, centre in (("a", 200, (0, 0)), ("b", 180, (2, 1)), ("c", 160, (0, 3))):
        for p in rng.normal(size=(n, 2)) + centre:
            rows.append((i, label, f"{label}_{i % 2}", i, float(p[0]), float(p[1])))
            i += 1
    return spark.createDataFrame(rows, "row_id long, label string, session string, start long, x0 double, x1 double").cache(), rows


def by_numpy(rows, kind):
    x = np.array([r[4:] for r in rows])
    y = np.array([r[1] for r in rows])
    classes = sorted(set(y))
    covs = [np.cov(x[y == c].T) for c in classes]
    n = [(y == c).sum() for c in classes]
    if kind == "lda":
        covs = [sum((k - 1) * c for k, c in zip(n, covs)) / (len(y) - 3)] * 3
    s = []
    for c, k, cov in zip(classes, n, covs):
        d = x - x[y == c].mean(0)
        s.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(k / len(y)))
    return [classes[i] for i in np.argmax(s, 0)]


@pytest.mark.parametrize("kind", ["lda", "qda"])
def test_discriminants_equal_numpy(gaussian, kind):
    df, rows = gaussian
    model = models.fit(df, X, kind)
    want = by_numpy(rows, kind)
    assert [r.pred for r in models.predict(df, model, X).orderBy("row_id").collect()] == want
    assert [r.pred for r in models.predict_batches(df, {None: model}, X).orderBy("row_id").collect()] == want


def test_degenerate_fits_are_refused(spark):
    rows = [("a", float(i), float(i * i)) for i in range(3)] + [("b", float(i), 1.0 + i) for i in range(2)]
    df = spark.createDataFrame(rows, "label string, x0 double, x1 double")
    with pytest.raises(ValueError, match="class b"):
        models.fit(df, X, "qda")
    with pytest.raises(ValueError):
        models.from_stats("other", [], 2)


def test_model_documents(spark, gaussian, tmp_path):
    df, _ = gaussian
    model = models.fit(df, X, "qda", meta={"representation": "raw"})
    models.save_model(spark, model, f"{tmp_path}/m")
    back = models.load_model(spark, f"{tmp_path}/m")
    assert back["covs"] == model["covs"] and back["meta"]["representation"] == "raw"
    models.save_model(spark, {**model, "kind": "tree"}, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        models.load_model(spark, f"{tmp_path}/t")
    models.save_model(spark, {**model, "covs": None}, f"{tmp_path}/n")
    with pytest.raises(ValueError):
        models.load_model(spark, f"{tmp_path}/n")


@pytest.mark.parametrize("k, n, low, high", [(248, 270, 0.87, 0.95), (270, 270, 0.98, 1.0), (0, 10, 0.0, 0.28)])
def test_wilson(spark, k, n, low, high):
    df = spark.createDataFrame([("a", "a")] * k + [("a", "b")] * (n - k), "label string, pred string")
    s = ev.score(df).first()
    assert (s.n, s.n_correct) == (n, k) and s.low == pytest.approx(low, abs=0.02) and s.high == pytest.approx(high, abs=0.02)


def test_time_blocked_sizes(spark):
    rows = [(f"{c}{i}", c, "s", i) for c, n in (("x", 35), ("y", 48), ("z", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id string, label string, session string, start long")
    got = splits.time_blocked(df).join(df, "row_id").groupBy("label", "side").count().collect()
    assert {(r.label, r.side): r["count"] for r in got} == {("x", "train"): 21, ("x", "test"): 14, ("y", "train"): 29, ("y", "test"): 19, ("z", "train"): 18, ("z", "test"): 12}


def test_folds_cover_and_do_not_leak(gaussian):
    df, rows = gaussian
    a = splits.leave_one_session_out(df)
    assert a.filter("side = 'test'").select("row_id").distinct().count() == len(rows)
    assert splits.disjoint(df, a).count() == 0
    pred, failed = ev.evaluate_folds(df, a, X)
    assert not failed and pred.count() == len(rows)


def test_paired_tests(spark):
    assert ev.binomial_two_sided(16, 8)[0] == pytest.approx(0.1516, abs=1e-4)
    assert ev.binomial_two_sided(0, 0) == (1.0, 1.0)
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "t string, p double")
    got = {r.t: r.p_holm for r in ev.holm(df).collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None


def points(spark, rows):
    return spark.createDataFrame(rows, "sensor int, count int, force_n double")


def test_sensor_fits(spark):
    x = lambda c: c / (4095 - c)
    rows = [(0, c, 25 * x(c) + 0.4) for c in (500, 900, 1500, 2200, 3000)] + [(1, c, 1.0 * i) for i, c in enumerate((500, 520, 540))]
    rows += [(2, c, f) for c, f in ((500, 1.0), (1500, 9.0), (2500, 2.0), (3500, 4.0))] + [(3, 500, 1.0), (3, 4090, 2.0), (3, 0, 0.0)]
    got = {r.sensor: r for r in cal.fit_sensors(points(spark, rows)).collect()}
    assert got[0].flag == "ok" and got[0].a == pytest.approx(25) and got[0].b == pytest.approx(0.4)
    assert [got[i].flag for i in range(1, 6)] == ["flat", "poor_fit", "few_points", "no_data", "no_data"]
    assert (got[3].n_points, got[3].n_saturated, got[3].n_dropped) == (1, 1, 1)


def manifest(spark, rows):
    return spark.createDataFrame(rows, "sensor int, force_n double, count_mean double, timestamp_iso timestamp")


def test_matched_cycle(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(s, 1.0, 900.0, t) for s in range(6)] + [(s, 11.5 + s / 10, 900.0 + s, t + dt.timedelta(minutes=35)) for s in range(6)]
    gains = cal.derive_gain_match(cal.select_matched_cycle(manifest(spark, rows))).collect()
    assert len(gains) == 6 and np.mean([r.correction for r in gains]) == pytest.approx(1)
    with pytest.raises(ValueError, match="sensor 5: 0"):
        cal.select_matched_cycle(manifest(spark, rows[:-1]))
    with pytest.raises(ValueError, match="sensor 0: 2"):
        cal.select_matched_cycle(manifest(spark, [*rows, (0, 11.6, 900.0, t + dt.timedelta(minutes=99))]))


def test_manifest_files(spark, tmp_path):
    head = "sensor,trial,csv_path,g_min,g_max,force_n,sigma_force_n,n_samples,count_mean,count_sd,saturated_frac,timestamp_iso"
    row = "1,2,c.csv,10,12,0.1,0.01,200,900.5,3.25,0.0,2024-01-01T10:00:00+02:00"
    (tmp_path / "m.csv").write_text(f"{head}\n\n{row}\n")
    got = documents.read_manifest(spark, f"{tmp_path}/m.csv").collect()
    assert len(got) == 1 and got[0].count_mean == 900.5 and got[0].timestamp_iso == dt.datetime(2024, 1, 1, 8)
    documents.append_trials(documents.read_manifest(spark, f"{tmp_path}/m.csv"), f"{tmp_path}/folder")
    documents.append_trials(documents.read_manifest(spark, f"{tmp_path}/m.csv"), f"{tmp_path}/folder")
    assert documents.read_manifest(spark, f"{tmp_path}/folder").count() == 2
    (tmp_path / "short.csv").write_text("1,2\n")
    (tmp_path / "bad.csv").write_text(row.replace("900.5", "many") + "\n")
    for name, words in (("short", "too few"), ("bad", "does not parse")):
        with pytest.raises(Exception, match=words):
            documents.read_manifest(spark, f"{tmp_path}/{name}.csv").collect()
    (tmp_path / "none.csv").write_text(head + "\n")
    with pytest.raises(ValueError):
        documents.read_manifest(spark, f"{tmp_path}/none.csv")


def test_gain_documents(spark, tmp_path):
    documents.save_gain_match(spark, {0: 3.0}, {0: 1.5, 1: 0.5}, f"{tmp_path}/g")
    assert documents.load_gain_match(spark, f"{tmp_path}/g") == ({0: 1.5, 1: 0.5}, 4095)


def test_catalogue(spark):
    names = ["walk_02.csv", "walk_01.csv", "check_all.csv", "cal_s3_t4.csv", "cal_s3_t9.csv", "cal_s2_500g.csv"]
    paths = spark.createDataFrame([(f"/d/{n}",) for n in names], "path string")
    got = {r.name: r for r in documents.session_catalog(paths).collect()}
    assert set(got) == {"walk_02", "cal_s3_t4", "cal_s3_t9", "cal_s2_500g"} and got["walk_02"].label == "walk" and got["cal_s2_500g"].grams == 500
    assert [(r.sensor, r.next_trial) for r in documents.next_trial(paths).collect()] == [(3, 10)]


def test_captures_refuse_a_wrong_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seq,ts_us,s0,s1,s2,s3,s4,s5\n1,2,3,4,5,6,7,8\n2,3,3,4,5,6,7,8\n")
    assert [r.frame_idx for r in logs.read_capture_csv(spark, f"{tmp_path}/a.csv").collect()] == [0, 1]
    (tmp_path / "b.csv").write_text("seq,ts,s0,s1,s2,s3,s4,s5\n1,2,3,4,5,6,7,8\n")
    with pytest.raises(Exception):
        logs.read_capture_csv(spark, f"{tmp_path}/b.csv").collect()


def test_matching(spark):
    make = lambda rows: spark.createDataFrame([("a", *r) for r in rows], "session_id string, start long, end long")
    det, truth = make([(0, 10), (20, 30), (100, 110)]), make([(2, 12), (22, 40), (50, 60)])
    b = matching.boundary_report(det, truth).first()
    assert (b.n_matched, b.start_offset, b.end_offset, b.duration_error) == (2, -2.0, -6.0, -4.0)
    s = matching.scorecard(det, truth).first()
    assert (s.tp, s.fp, s.fn) == (1, 2, 2) and s.f1 == pytest.approx(1 / 3)
