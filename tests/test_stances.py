import json
import random

import pytest

from strideforge.operators import features as ft
from strideforge.operators import stances as st
from strideforge.schemas import CHANNELS


def frames_of(spark, sessions):
    """sessions: {key: totals}; each total goes to the six channels as evenly as integers allow."""
    rows = []
    for key, totals in sessions.items():
        for i, x in enumerate(totals):
            s = [x // 6 + (1 if k < x % 6 else 0) for k in range(6)]
            rows.append((key, 0, i, i * 10000, x, *s))
    return spark.createDataFrame(rows, "session_id string, epoch int, frame_idx long, ts_us long, total long, " + ", ".join(f"{c} int" for c in CHANNELS))


def by_loop(x, t_on, t_off, least, most):
    """The detector as a loop with a latch: the oracle of the window form."""
    out, start, armed = [], None, True
    for i, v in enumerate(x):
        if start is None:
            if not armed:
                armed = v < t_off
            elif v >= t_on:
                start = i
        elif v < t_off:
            if i - start >= least:
                out.append((start, i - 1))
            start = None
        elif i - start + 1 > most:
            start, armed = None, False
    if start is not None and least <= len(x) - start <= most:
        out.append((start, len(x) - 1))
    return out


def merged(stances, gap):
    out = []
    for a, b in stances:
        if out and a - out[-1][1] - 1 < gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_windows_equal_the_loop(spark):
    rnd = random.Random(3)
    for t_on, t_off, least, most, gap in [(1200, 450, 3, 20, 4), (1000, 999, 1, 7, 1), (1500, 200, 5, 40, 12)]:
        walks = {}
        for k in range(120):
            x, v = [], rnd.randrange(0, 2000)
            for _ in range(rnd.randrange(0, 90)):
                v = max(0, min(2400, v + rnd.randrange(-500, 501)))
                x.append(v)
            walks[f"w{k}"] = x
        f = frames_of(spark, walks)
        got = {}
        m = st.merge_close(st.find_stances(f, t_on=t_on, t_off=t_off, min_duration=least, max_duration=most), gap)
        for r in m.collect():
            got.setdefault(r.session_id, []).append((r.start, r.end))
        want = {k: merged(by_loop(x, t_on, t_off, least, most), gap) for k, x in walks.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        inside = st.frames_in_stances(f, t_on=t_on, t_off=t_off, min_duration=least, max_duration=most, gap=gap)
        spans = {(r.session_id, r.start, r.end) for r in inside.select("session_id", "start", "end").distinct().collect()}
        assert spans == {(k, a, b) for k, v in want.items() for a, b in v}
        assert inside.count() == sum(b - a + 1 for v in want.values() for a, b in v)


@pytest.mark.parametrize(
    "given, want",
    [([(0, 10), (40, 50)], [(0, 10), (40, 50)]), ([(0, 10), (15, 25)], [(0, 25)]), ([(0, 10), (15, 25), (30, 40)], [(0, 40)]), ([(0, 10), (23, 33)], [(0, 10), (23, 33)])],
)
def test_merge_cases(spark, given, want):
    df = spark.createDataFrame([("a", *x) for x in given], "session_id string, start long, end long")
    assert [(r.start, r.end) for r in st.merge_close(df).orderBy("start").collect()] == want


def test_lengths_at_the_bounds(spark):
    on = lambda n, tail: [0] * 3 + [2000] * n + [0] * tail
    f = frames_of(spark, {f"{n}{t}": on(n, 5 * t) for n in (14, 15, 200, 201) for t in (0, 1)})
    kept = {r.session_id for r in st.find_stances(f).collect()}
    assert kept == {"150", "151", "2000", "2001"}


def test_thresholds_are_checked(spark):
    with pytest.raises(ValueError):
        st.find_runs(frames_of(spark, {"a": [1]}), t_on=1, t_off=1)


def test_features_of_a_pulse(spark):
    r = ft.extract_features(frames_of(spark, {"a": [0] * 5 + [1200] * 10 + [3000] + [1200] * 9 + [0] * 20})).collect()
    assert len(r) == 1 and (r[0].start, r[0].end) == (5, 24)
    assert r[0].peak_counts == 3000 and r[0].time_to_peak_s == pytest.approx(0.1) and r[0].contact_time_s == pytest.approx(0.19)
    assert r[0].impulse_counts_s == pytest.approx((1200 * 18 + 3000) * 0.01) and r[0].loading_rate_cps == pytest.approx(18000)
    assert r[0].cop_path_len == pytest.approx(0.0, abs=1e-9)


def line(seq, ts, s):
    return f"INS,{seq},{ts},{','.join(map(str, s))},{(seq + ts + sum(s)) % 256}"


def test_tracker_equals_the_batch(spark):

    from strideforge.functions.frames import parse_frames, total_force
    from strideforge.operators.link import link_accounting
    from strideforge.streaming.live import END, Tracker

    rnd = random.Random(8)
    lines, live = [], []
    for k in range(40):
        key, tracker, no, seq, ts, v = f"s{k}", None, 0, 0, 0, 0
        for i in range(rnd.randrange(30, 400)):
            if rnd.random() < 0.006:
                seq = ts = 0
            v = max(0, min(4000, v + rnd.randrange(-900, 950)))
            text = line(seq, ts, [v // 6] * 6)
            lines.append((key, no, text))
            tracker = Tracker(json.loads(json.dumps(tracker.d)) if tracker else None, min_duration=4, max_duration=30, gap=3)
            live += [(key, e["kind"], e["epoch"], e["start"], e["end"], e["emit_idx"]) for e in tracker.line(no, text)]
            no, seq, ts = no + 1, seq + 1, ts + 10000
        live += [(key, e["kind"], e["epoch"], e["start"], e["end"], e["emit_idx"]) for e in tracker.line(no, END) if e["kind"] != "end"]
    df = spark.createDataFrame(lines, "session_id string, line_no long, value string")
    f = link_accounting(parse_frames(df)).withColumn("total", total_force())
    got = st.stance_events(f, min_duration=4, max_duration=30, gap=3).select("session_id", "kind", "epoch", "start", "end", "emit_idx")
    assert sorted(map(str, live)) == sorted(str(tuple(r)) for r in got.collect())


def test_given_intervals_keep_all_their_frames(spark):
    rnd = random.Random(11)
    walks = {f"w{k}": [rnd.randrange(0, 3000) for _ in range(rnd.randrange(1, 900))] for k in range(6)}
    f = frames_of(spark, walks)
    spans = [(k, *sorted((rnd.randrange(-50, 1200), rnd.randrange(-50, 1200)))) for k in walks for _ in range(25)]
    spans += [("w0", 5, 5), ("w0", 5, 5), ("w0", None, 9), ("w0", 9, 3), ("gone", 0, 9)]
    given = spark.createDataFrame(spans, "session_id string, start long, end long")
    for bucket in (1, 17, 256):
        got = sorted((r.session_id, r.start, r.end, r.frame_idx) for r in st.frames_in_intervals(f, given, bucket=bucket).collect())
        assert got == sorted((k, a, b, i) for k, a, b in spans if a is not None and k in walks for i in range(max(a, 0), min(b, len(walks[k]) - 1) + 1))


def test_features_of_given_stances_equal_those_of_the_same_detected_ones(spark):
    x = ([0] * 20 + [1300, 2500, 2400, 1800] * 6) * 5 + [0] * 20
    f = frames_of(spark, {"a": x, "b": x[7:]})
    detected = ft.extract_features(f)
    given = detected.select("session_id", "stance", "start", "end")
    assert sorted(map(str, ft.extract_features(f, stances=given).collect())) == sorted(map(str, detected.collect()))
    edited = given.withColumn("end", given["end"] + 3)
    assert {r.n_frames for r in ft.extract_features(f, stances=edited).collect()} == {27}
    assert ft.extract_features(f, stances=given.limit(0)).count() == 0
