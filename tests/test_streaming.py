import random
import time

import pytest
from pyspark.sql import functions as F

from strideforge.functions.frames import parse_frames, total_force
from strideforge.operators import features as ft
from strideforge.operators import stances as st
from strideforge.operators.link import link_accounting
from strideforge.sources.logs import line_stream
from strideforge.streaming import live

SCHEMA = "session_id string, line_no long, value string, arrival_ts timestamp"
DETECT = {"min_duration": 4, "max_duration": 30, "gap": 3}


def line(seq, ts, s):
    return f"INS,{seq},{ts},{','.join(map(str, s))},{(seq + ts + sum(s)) % 256}"


def walks(n, seed, restarts=0.004):
    rnd, out = random.Random(seed), {}
    for k in range(n):
        seq, ts, v, lines = 0, 0, 0, []
        for i in range(rnd.randrange(60, 300)):
            if rnd.random() < restarts:
                seq = ts = 0
            v = max(0, min(4000, v + rnd.randrange(-900, 950)))
            lines.append(line(seq, ts, [(v + 37 * c) // 6 for c in range(6)]) if rnd.random() > 0.02 else rnd.choice(["", "# s=1", "INS,1,2", line(seq, ts, [1] * 6)[:-1] + "x"]))
            seq, ts = seq + 1, ts + 10000
        out[f"s{k}"] = lines
    return out


def write(spark, base, rows):
    """One micro-batch's arrival: a single file."""
    spark.createDataFrame(rows, "session_id string, line_no long, value string, s double").select("session_id", "line_no", "value", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("arrival_ts")).coalesce(1).write.mode("append").json(base)
    time.sleep(0.05)


def events(spark, tmp_path, parts, **settings):
    base = str(tmp_path / f"b{len(list(tmp_path.iterdir()))}")
    for rows in parts:
        write(spark, f"{base}/in", rows)
    stream = live.live_stances(line_stream(spark, f"{base}/in", 1), stall_s=0, **settings)
    return live.run_now(stream, f"{base}/out", f"{base}/ck")


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_streaming_equals_the_batch_over_any_cut(spark, tmp_path, cuts):
    sessions = walks(16, 5, 0.002)
    lines = [(s, i, v, 0.0) for s, x in sessions.items() for i, v in enumerate(x)]
    rnd = random.Random(cuts)
    bounds = {s: sorted(rnd.randrange(len(x)) for _ in range(cuts - 1)) for s, x in sessions.items()}
    part = lambda s, i: sum(i >= b for b in bounds[s])
    parts = [[r for r in lines if part(r[0], r[1]) == k] for k in range(cuts)]
    parts.append([(s, len(x), live.END, 0.0) for s, x in sessions.items()])
    got = events(spark, tmp_path, [p for p in parts if p], **DETECT)
    f = link_accounting(parse_frames(spark.createDataFrame([r[:3] for r in lines], "session_id string, line_no long, value string"))).withColumn("total", total_force())
    want = st.stance_events(f, **DETECT)
    cols = ["session_id", "kind", "epoch", "start", "end", "emit_idx"]
    assert sorted(str(tuple(r)) for r in got.filter("kind <> 'end'").select(*cols).collect()) == sorted(str(tuple(r)) for r in want.select(*cols).collect())
    # features of sessions without a restart equal the batch ones, but for the step, which is the median so far
    whole = {r.session_id for r in f.groupBy("session_id").agg(F.max("epoch").alias("e")).filter("e = 0").collect()}
    batch = {(r.session_id, r.start, r.end): r for r in ft.extract_features(f, **DETECT).collect() if r.session_id in whole}
    mine = {(r.session_id, r.start, r.end): r for r in got.filter("kind = 'stance'").collect() if r.session_id in whole}
    assert mine.keys() == batch.keys() and len(mine) > 12
    for k, r in mine.items():
        for c in ("peak_counts", "contact_time_s", "cop_path_len", "cop_displacement", "impulse_counts_s", "time_to_peak_s", "loading_rate_cps"):
            assert (r[c] is None) == (batch[k][c] is None) and (r[c] is None or r[c] == pytest.approx(batch[k][c], abs=1e-9)), (k, c)


def test_late_lines_and_lines_outside_the_capture(spark, tmp_path):
    good = [("a", i, line(i, i * 10000, [0] * 6), i * 0.01) for i in range(100)]
    again = [("a", i, good[i][2], 1.5) for i in (5, 50, 99)]
    beyond = [("a", 100 + i, line(100 + i, (100 + i) * 10000, [0] * 6), 60.0 + i) for i in range(7)]
    out = events(spark, tmp_path, [good, again, beyond, [("a", 200, live.END, 90.0)]], duration_s=20.0)
    end = out.filter("kind = 'end'").first()
    assert end.counters["late"] == 3 and end.counters["outside"] == 7 and end.counters["valid"] == 100
    free = events(spark, tmp_path, [good, again, beyond, [("a", 200, live.END, 90.0)]])
    assert free.filter("kind = 'end'").first().counters["valid"] == 107


def test_a_session_that_ended_leaves_no_state(spark, tmp_path):
    good = [("a", i, line(i, i * 10000, [0] * 6), 0.0) for i in range(10)]
    write(spark, f"{tmp_path}/in", good)
    write(spark, f"{tmp_path}/in", [("a", 10, live.END, 0.0)])
    query = live.live_stances(line_stream(spark, f"{tmp_path}/in", 1), stall_s=0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [total for total, _, _ in live.state_size(query)]
    assert rows[0] == 3 and rows[-1] == 0  # the link, the counters, one step of the clock


def test_a_stalled_session_is_closed(spark, tmp_path):
    on = [2000 // 6] * 6
    write(spark, f"{tmp_path}/in", [("a", i, line(i, i * 10000, on if 5 <= i else [0] * 6), 0.0) for i in range(30)])
    stream = live.live_stances(line_stream(spark, f"{tmp_path}/in"), stall_s=1.0)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="300 milliseconds").start()
    try:
        until, found = time.time() + 60, set()
        while time.time() < until and "stalled" not in found:
            time.sleep(0.5)
            try:
                found = {r.kind for r in spark.read.schema(live.OUTPUT).parquet(f"{tmp_path}/out").collect()}
            except Exception:
                pass
    finally:
        query.stop()
    assert found == {"stance", "stalled"}


def test_representations_are_checked():
    model = {"kind": "lda", "classes": [], "meta": {"representation": "gain_matched"}}
    with pytest.raises(ValueError, match="gains"):
        live.live_stances(None, model)
    with pytest.raises(ValueError, match="made for gain_matched"):
        live.live_stances(None, model, rep="raw", gains={0: 1.0})
    with pytest.raises(ValueError, match="no known"):
        live.live_stances(None, {**model, "meta": {"representation": "other"}})


def watched(spark, tmp_path, parts, **settings):
    """Events of a replay that goes by the arrival times of its lines."""
    base = str(tmp_path / f"w{len(list(tmp_path.iterdir()))}")
    for rows in parts:
        write(spark, f"{base}/in", rows)
    stream = live.live_stances(line_stream(spark, f"{base}/in", 1), clock="arrival", **settings)
    return [(r.session_id, r.kind, round(r.at.timestamp() - 100, 3) if r.at else None, r.counters["valid"]) for r in live.run_now(stream, f"{base}/out", f"{base}/ck").collect()]


def test_silence_and_status_by_the_clock_of_arrivals(spark, tmp_path):
    at = lambda key, i, s: (key, i, line(i, i * 10000, [0] * 6), 100 + s)
    quiet = [at("quiet", i, 0.1 * i) for i in range(10)]
    back = [at("back", i, 0.1 * i + (5.0 if i >= 5 else 0.0)) for i in range(10)]
    steady = [at("steady", i, 0.5 * i) for i in range(40)]
    rows = sorted(quiet + back + steady, key=lambda r: r[3])
    want = {("quiet", "stalled", 3.9, 10), ("back", "stalled", 3.4, 5), ("back", "stalled", 8.9, 5)}
    for cuts in ([], [3.0], [0.45, 2.0, 6.0, 12.0]):
        parts = [[r for r in rows if sum(r[3] > 100 + c for c in cuts) == k] for k in range(len(cuts) + 1)]
        got = watched(spark, tmp_path, parts, stall_s=3.0)
        assert len(got) == len(want) and set(got) == want
        status = watched(spark, tmp_path, parts, stall_s=3.0, status_s=2.0)
        of = lambda key: sorted(r[2:] for r in status if r[0] == key and r[1] == "status")
        assert of("quiet") == [(2.0, 10)]
        assert of("back") == [(2.0, 5), (7.5, 5)]
        assert of("steady") == [(2.0 * k, 4 * k + 1) for k in range(1, 10)]
    free = watched(spark, tmp_path, [rows], stall_s=None)
    assert free == []  # a replay without a watch cannot stall


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """The rows of state that a micro-batch writes do not grow with what the session has been through."""
    no = 0
    for _ in range(5):
        write(spark, f"{tmp_path}/in", [("a", no + i, line((no + i) % 65536, (no + i) * 10000, [0] * 6), 0.0) for i in range(200)])
        no += 200
    query = live.live_stances(line_stream(spark, f"{tmp_path}/in", 1), stall_s=0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(total, written) for total, written, _ in live.state_size(query)] == [(3, 3)] * 5
