import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideforge.operators import evaluate as ev
from strideforge.operators import link, logistic, matching, models, reports, splits
from strideforge.sources import documents, logs

X = ["x0", "x1"]
SCHEMA = "row_id long, label string, session string, start long, x0 double, x1 double"


def made(n=240, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = i % 3
        p = rng.normal(size=2) + [(0, 0), (2, 1), (0, 3)][k]
        out.append((i, "abc"[k], f"{'abc'[k]}_{(i // 3) % 4}", i, float(p[0]), float(p[1])))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), SCHEMA).cache()


@pytest.mark.parametrize("kind", ["lda", "qda"])
def test_held_out_equals_folds(rows, kind):
    for compact, table in ((splits.block_of(rows, 5), splits.contiguous_blocks(rows, 5)), (splits.held_session(rows), splits.leave_one_session_out(rows))):
        a, fits = ev.evaluate_held_out(compact, X, kind)
        b, failed = ev.evaluate_folds(rows, table, X, kind)
        assert fits.filter("reason is not null").count() == 0 and fits.count() == compact.select("fold").distinct().count() and not failed
        key = lambda p: sorted((r.fold, r.row_id, r.label, r.session, r.pred) for r in p.collect())
        assert key(a) == key(b)


def test_values_that_are_not_finite_are_missing(spark, rows):
    model = models.fit(rows, X)
    odd = spark.createDataFrame([(0, float("nan"), 1.0), (1, float("inf"), 1.0), (2, None, 1.0), (3, 0.0, 0.0)], "row_id long, x0 double, x1 double")
    for found in (models.predict(odd, model, X), models.predict_batches(odd, {None: model}, X)):
        assert [r.pred for r in found.orderBy("row_id").collect()] == [None, None, None, "a"]
    both = rows.unionByName(spark.createDataFrame([(900, "a", "a_0", 900, float("inf"), 0.0)], SCHEMA))
    assert models.fit(both, X)["counts"] == model["counts"]


def newton_by_hand(x, y, classes, steps=60):
    """Plain gradient descent with backtracking on the penalised loss."""
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    k = np.searchsorted(classes, y)
    w = np.zeros((len(classes), z.shape[1]))

    def loss(w):
        s = z @ w.T
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(k)), k]).sum() + 0.5 * (w[:, 1:] ** 2).sum()

    for _ in range(4000):
        p = logistic.softmax(z @ w.T)
        p[np.arange(len(k)), k] -= 1
        g = p.T @ z
        g[:, 1:] += w[:, 1:]
        w = w - 0.01 * g
        if np.abs(g).max() < 1e-7:
            break
    return w, z, loss


def test_logistic_of_all_cells_is_the_minimum(rows):
    placed = splits.block_of(rows.withColumn("rep", F.lit("raw")), 4, ["rep"]).withColumn("fold", F.col("fold").cast("int"))
    stats = [r.asDict() for r in models.class_stats(placed, X, "label", ["rep", "fold"]).collect()]
    fitted = logistic.fit_without(placed, {"raw": stats}, X)
    data = placed.toPandas()
    for fold in range(4):
        train = data[data.fold != fold]
        w, z, loss = newton_by_hand(train[X].to_numpy(), train.label.to_numpy(str), ["a", "b", "c"])
        mine = fitted["raw", fold]["w"]
        assert np.allclose(mine[:, 1:] - mine[:, 1:].mean(0), w[:, 1:] - w[:, 1:].mean(0), atol=1e-3) and loss(mine) <= loss(w) + 1e-6


def test_spark_logistic_agrees_with_newton(rows):
    data = rows.toPandas()
    w, z, _ = newton_by_hand(data[X].to_numpy(), data.label.to_numpy(str), ["a", "b", "c"])
    want = [["a", "b", "c"][k] for k in np.argmax(z @ w.T, 1)]
    got = [r.pred for r in models.predict_logistic(rows, models.fit_logistic(rows, X), X, rows).orderBy("row_id").collect()]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.99


def test_grid_cells(spark, rows):
    stacked = rows.withColumn("rep", F.lit("raw")).unionByName(rows.withColumn("rep", F.lit("other")).withColumn("x0", -F.col("x0")))
    cells = ev.grid(stacked, {"two": X, "one": ["x1"]}, k=4)
    n = {(r["rep"], r.fset, r.kind): r.n for r in ev.score(cells, ["rep", "fset", "kind"]).collect()}
    assert len(n) == 12 and set(n.values()) == {240}
    lda = ev.evaluate_held_out(splits.block_of(rows, 4), X, "lda")[0]
    want = {r.row_id: r.pred for r in lda.collect()}
    assert {r.row_id: r.pred for r in cells.filter("rep = 'raw' and fset = 'two' and kind = 'lda'").collect()} == want


def test_split_checks(rows):
    leaking = splits.time_blocked(rows)
    assert splits.disjoint(rows, leaking).count() > 0 and splits.disjoint(rows, splits.leave_one_session_out(rows)).count() == 0
    assert {(r.n_tested, r.n_both) for r in splits.coverage(rows, splits.contiguous_blocks(rows)).collect()} == {(1, 0)}
    assert {r.n_tested for r in splits.coverage(rows, leaking).collect()} == {0, 1}


def test_floors(spark):
    make = lambda s: spark.createDataFrame([(c,) for c in s], "label string")
    r = reports.majority_floor(make("aaabb"), make("bbc")).first()
    assert (r.floor_all, r.floor_test, r.train_top, r.train_on_test, r.n_test) == (0.5, pytest.approx(2 / 3), "a", 0.0, 3)
    r = reports.majority_floor(make("ab"), make("")) if False else reports.majority_floor(make("ba"), make("a")).first()
    assert r.train_top == "a" and r.train_on_test == 1.0


def greedy(det, truth, share):
    free, out = list(truth), []
    for a, b in sorted(det):
        best = None
        for s, e in free:
            n = min(b, e) - max(a, s) + 1
            if n > 0 and n >= share * (e - s + 1) and (best is None or n > best[0]):
                best = (n, s, e)
        if best:
            free.remove(best[1:])
            out.append((a, b, *best[1:]))
    return out


def test_matching_equals_a_loop(spark):
    rnd = random.Random(4)

    def intervals():
        at, out = 0, []
        for _ in range(rnd.randrange(12)):
            at += rnd.randrange(1, 25)
            out.append((at, at + rnd.randrange(1, 40)))
            at += rnd.randrange(0, 30)
        return sorted(set(out))

    sides = {f"s{i}": (intervals(), intervals()) for i in range(40)}
    make = lambda k: spark.createDataFrame([(s, *x) for s, v in sides.items() for x in v[k]], "session_id string, start long, end long")
    det, truth = make(0), make(1)
    got = {r.session_id: r for r in matching.boundary_report(det, truth).collect()}
    for s, (d, t) in sides.items():
        m = greedy(d, t, 0.0)
        assert (s in got) == bool(m)
        if m:
            assert got[s].n_matched == len(m) and got[s].start_offset == pytest.approx(np.mean([a - x for a, _, x, _ in m])) and got[s].end_offset == pytest.approx(np.mean([b - y for _, b, _, y in m]))
    cards = {r.session_id: r for r in matching.scorecard(det, truth).collect()}
    for s, (d, t) in sides.items():
        tp = len(greedy(d, t, 0.5))
        if d or t:
            assert (cards[s].tp, cards[s].fp, cards[s].fn) == (tp, len(d) - tp, len(t) - tp)


def test_captures_without_overlap_and_first_mismatches(spark):
    schema = "session_id string, seq int, ts_us long, s0 int, s1 int, s2 int, s3 int, s4 int, s5 int"
    a = spark.createDataFrame([("a", i, i, 0, 0, 0, 0, 0, 0) for i in range(30)] + [("b", 1, 1, 0, 0, 0, 0, 0, 0)], schema)
    b = spark.createDataFrame([("a", i, i, i % 2, 0, 0, 0, 0, 0) for i in range(30)] + [("b", 2, 1, 0, 0, 0, 0, 0, 0)], schema)
    got = {r.session_id: r.verdict for r in matching.comparison_verdict(matching.compare_captures(a, b)).collect()}
    assert got == {"a": "mismatch", "b": "no_overlap"}
    assert [r.seq for r in matching.first_mismatches(a, b).orderBy("place").collect()] == list(range(1, 21, 2))
    assert matching.comparison_verdict(matching.compare_captures(a, a)).filter("verdict = 'same'").count() == 2


def test_chunks_equal_a_loop(spark):
    rnd, rows, want = random.Random(6), [], {}
    for s in range(20):
        text = "".join(rnd.choice(["a", "bc", " ", "\n", "\n\n"]) for _ in range(rnd.randrange(120)))
        at = n = 0
        while at < len(text):
            size = rnd.randrange(1, 9)
            rows.append((f"s{s}", n, text[at : at + size]))
            at, n = at + size, n + 1
        want[f"s{s}"] = [p.strip(" ") for p in text.split("\n")[:-1] if p.strip(" ")]
    got = {}
    for r in logs.reassemble_lines(spark.createDataFrame(rows, "session_id string, chunk_no long, bytes string")).orderBy("session_id", "line_no").collect():
        assert r.line_no == len(got.setdefault(r.session_id, []))
        got[r.session_id].append(r.value)
    assert got == {k: v for k, v in want.items() if v}


def test_logs_are_read_in_order_over_splits(spark, tmp_path):
    (tmp_path / "one.log").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    (tmp_path / "two.log").write_text("a\n\n b \nlast")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        got = logs.read_frame_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    one = [r.value for r in sorted(got, key=lambda r: r.line_no) if r.session_id.endswith("one.log")]
    assert [int(v.split()[1]) for v in one] == list(range(20_000))
    assert [r.value for r in sorted(got, key=lambda r: r.line_no) if r.session_id.endswith("two.log")] == ["a", "", "b", "last"]


def test_fingerprints_and_calibration_documents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"some bytes")
    assert [(r.name, r.sha256) for r in documents.fingerprint(spark, f"{tmp_path}/a.bin").collect()] == [("a.bin", hashlib.sha256(b"some bytes").hexdigest())]
    fits = spark.createDataFrame([(0, 1.5, 0.25, 0.99, "ok", 5, 0.1, 2.0), (1, None, None, None, "no_data", 0, None, None)], "sensor int, a double, b double, r2 double, flag string, n_points long, x_min double, x_max double")
    documents.save_calibration(fits, f"{tmp_path}/fits")
    got = documents.load_calibration(spark, f"{tmp_path}/fits")
    assert got[0]["a"] == 1.5 and got[0]["x_max"] == 2.0 and got[1]["flag"] == "no_data" and got[1]["a"] is None
    rows = spark.createDataFrame([(1, "x")], "stance int, pred string")
    logs.write_predictions(rows, f"{tmp_path}/p")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/p").collect()] == [("1", "x")]


def test_capture_report_of_arrivals(spark):
    from strideforge.functions.frames import parse_frames

    line = lambda i: f"INS,{i},{i * 10000},1,1,1,1,1,1,{(i + i * 10000 + 6) % 256}"
    rows = [("a", i, line(i), i) for i in range(5)] + [("a", 9, "junk", 99), ("b", 0, "# none", 0)]
    df = spark.createDataFrame(rows, "session_id string, line_no long, value string, s long").withColumn("arrival_ts", F.timestamp_seconds("s")).drop("s")
    got = {r.session_id: r for r in link.capture_report(link.link_lines(parse_frames(df)), 4.5).collect()}
    assert (got["a"].host_s, got["a"].short_s, got["a"].n_malformed, got["a"].lost) == (4.0, None, 1, 0)
    assert (got["b"].host_s, got["b"].short_s, got["b"].n_valid, got["b"].resets, got["b"].loss_pct) == (None, 4.5, 0, 0, 0.0)
