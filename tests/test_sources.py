"""The seam of live lines: growing logs, pieces of large files, Kafka records."""

import random

import pytest

from strideforge.sources import streams
from strideforge.streaming import live


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)


def test_pieces_of_a_file_give_its_lines_once(tmp_path):
    rng = random.Random(0)
    for trial in range(60):
        text = "".join(rng.choice(["a", "bc", "\n", "\n\n", "x" * 40, "é"]) for _ in range(rng.randrange(60)))
        write(tmp_path / "a.log", text)
        data = text.encode()
        store, path = streams._store(str(tmp_path / "a.log"))
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        if not want[-1][1]:
            want.pop()
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(5)))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in streams.lines_of(store, path, a, b)]
        assert got == want, (text, cuts)


def rows_of(spark, tmp_path, **options):
    stream = streams.line_stream(spark, str(tmp_path / "in"), "log", session=r"([^/]+)\.log", **options)
    return sorted(map(tuple, live.run_now(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()))


def test_growing_logs_are_followed(spark, tmp_path):
    write(tmp_path / "in" / "a.log", "one\r\ntwo\nhal")
    write(tmp_path / "in" / "sub" / "b.log", "\n\nlast\n")
    write(tmp_path / "in" / "other.csv", "not a log\n")
    first = [("a", 0, "one"), ("a", 5, "two"), ("b", 0, ""), ("b", 1, ""), ("b", 2, "last")]
    assert rows_of(spark, tmp_path) == first
    write(tmp_path / "in" / "a.log", "f\nmore", "a")
    write(tmp_path / "in" / "c.log", "new\n" * 50)
    more = [("a", 9, "half"), *(("c", 4 * i, "new") for i in range(50))]
    assert rows_of(spark, tmp_path, pieceBytes="17") == sorted(first + more)
    assert rows_of(spark, tmp_path, finished="true") == sorted(first + more + [("a", 14, "more")])


def test_stances_from_logs_that_grow_equal_those_of_whole_ones(spark, tmp_path):
    line = lambda i, x: f"INS,{i},{i * 10000},{','.join([str(x)] * 6)},{(i + i * 10000 + 6 * x) % 256}\n"
    text = "".join(line(i, 400 if i % 50 >= 20 else 0) for i in range(300)) + live.END + "\n"
    write(tmp_path / "whole" / "s.log", text)
    run = lambda where, out: live.run_now(live.live_stances(streams.line_stream(spark, str(tmp_path / where), "log"), stall_s=None), str(tmp_path / out), str(tmp_path / f"{out}-ck"))
    want = sorted((r.kind, r.start, r.end, r.emit_idx, r.peak_counts) for r in run("whole", "o1").collect() if r.kind != "end")
    assert len(want) == 6
    for at in (0, 2500, 2507, 9000):
        write(tmp_path / "parts" / "s.log", text[at : at + 2500] if at in (0,) else "", "a")
    for a, b in ((2500, 2507), (2507, 9000), (9000, len(text))):
        got = run("parts", "o2")
        write(tmp_path / "parts" / "s.log", text[a:b], "a")
    got = sorted((r.kind, r.start, r.end, r.emit_idx, r.peak_counts) for r in run("parts", "o2").collect() if r.kind != "end")
    assert got == want


def test_kafka_records_are_lines(spark):
    records = spark.createDataFrame([(bytearray(b"s1"), bytearray(b"INS,1"), "t", 0, 7)], "key binary, value binary, topic string, partition int, offset long").selectExpr("*", "timestamp'2024-01-01' as timestamp")
    row = streams.kafka_lines(records).first()
    assert (row.session_id, row.line_no, row.value) == ("s1", 7, "INS,1") and row.arrival_ts is not None
    with pytest.raises(ValueError):
        streams.line_stream(spark, "x", "serial")
