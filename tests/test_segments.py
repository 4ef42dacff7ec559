"""Sessions cut at arbitrary places give what whole sessions give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strideforge.functions.frames import parse_frames, total_force
from strideforge.operators import link
from strideforge.operators import segments as sg
from strideforge.operators import stances as st


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x, y = (sorted(str(tuple(r)) for r in df.select(*cols).collect()) for df in (a, b))
    assert x and x == y


def line(seq, ts, s):
    return f"INS,{seq},{ts},{','.join(map(str, s))},{(seq + ts + sum(s)) % 256}"


@pytest.fixture(scope="module")
def parsed(spark):
    rnd, rows = random.Random(4), []
    for k in range(60):
        no = seq = ts = v = 0
        for _ in range(rnd.randrange(1, 260)):
            if rnd.random() < 0.01:
                seq = ts = 0
            if rnd.random() < 0.03:
                seq += rnd.randrange(0, 3)
            v = max(0, min(4000, v + rnd.randrange(-900, 950)))
            text = line(seq, ts, [v // 6] * 6)
            if rnd.random() < 0.05:
                text = rnd.choice(["", "junk", "# ble x", text[:-1] + ("1" if text[-1] != "1" else "2")])
            rows.append((f"s{k}", no, text))
            no, seq, ts = no + rnd.choice([1, 1, 1, 2]), (seq + 1) % 65536, ts + 10000 + rnd.choice([0, 0, 0, 4000])
    rows += [("empty", i, "") for i in range(30)]
    return parse_frames(spark.createDataFrame(rows, "session_id string, line_no long, value string").repartition(3)).cache()


@pytest.mark.parametrize("size", [1, 50])
def test_link_accounting(parsed, size):
    same(sg.link_lines(parsed, size), link.link_lines(parsed))


@pytest.mark.parametrize("size", [5, 33])
def test_stances_and_events(parsed, size):
    f = link.link_accounting(parsed).withColumn("total", total_force())
    one = f.filter("epoch = 0")
    kw = {"min_duration": 4, "max_duration": 30}
    same(sg.timed_runs(one, size=size), st.timed_runs(one))
    same(sg.find_stances(f, by=("session_id", "epoch"), size=size, **kw), st.find_stances(f, by=("session_id", "epoch"), **kw))
    for gap in (3, 40):
        found = st.timed_runs(one).filter(F.col("n_frames").between(4, 30))
        same(sg.merge_close(found, gap, max_duration=30, size=size), st.merge_close(found, gap))
        same(sg.stance_events(f, gap=gap, size=size, **kw), st.stance_events(f, gap=gap, **kw))


def test_arbitrary_cuts_and_long_runs(spark):
    rnd, rows = random.Random(6), []
    for k in range(40):
        segment, v = 0, 0
        for i in range(rnd.randrange(1, 200)):
            segment += rnd.random() < 0.2
            v = rnd.choice([v, v, v, 0, 800, 2000])
            rows.append((k, segment, i, i * 10000, v))
    rows += [(99, i // 3, i, i, 2000) for i in range(120)] + [(98, i, i, i, 800) for i in range(20)]
    f = spark.createDataFrame(rows, "session_id long, segment long, frame_idx long, ts_us long, total long").repartition(5)
    same(sg.timed_runs(f), st.timed_runs(f.drop("segment")))
    assert sg.find_runs(f.filter("session_id = 99")).count() == 1
    assert sg.find_runs(f.filter("session_id = 98")).count() == 0
    assert sg.find_runs(f.limit(0)).count() == 0


def test_no_task_holds_a_session(spark):
    """Windows over rows are partitioned by segment; those by session read a row for each segment."""
    f = spark.range(200_000).select(F.lit("one").alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") * 10000).alias("ts_us"), F.when(F.col("id") % 100 < 60, 2000).otherwise(0).alias("total"))
    found = sg.timed_runs(f, size=5000)
    assert found.count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"Window .*\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert specs and all("segment" in keys or order.startswith("segment") for keys, order in specs)
    with pytest.raises(ValueError):
        sg.find_runs(f, t_on=1, t_off=1)
