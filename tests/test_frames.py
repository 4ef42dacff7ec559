import math

import pytest

from strideforge.functions import frames as fx
from strideforge.functions.tails import t_two_sided
from strideforge.operators import link


def line(seq, ts, s, off=0, sync="INS"):
    return f"{sync},{seq},{ts},{','.join(map(str, s))},{(seq + ts + sum(s) + off) % 256}"


S = [2048, 1900, 300, 150, 2200, 3000]
CASES = [
    ("INS,41,152300,2048,1900,300,150,2200,3000,147", "valid"),
    (line(41, 152300, S), "valid"),
    ("  " + line(41, 152300, S) + " ", "valid"),
    (line(41, 152300, S, sync="INX"), "malformed"),
    (line(41, 152300, S[:5]), "malformed"),
    (line(41, 152300, [*S, 1]), "malformed"),
    (line(41, 152300, S, off=1), "bad_checksum"),
    (line(41, 152300, S)[:-1], "bad_checksum"),
    ("INS,41,152300,2048,1900,300,150,2200,3000,", "malformed"),
    ("INS,x,152300,2048,1900,300,150,2200,3000,147", "malformed"),
    (line(1, 2, [4096, 0, 0, 0, 0, 0]), "malformed"),
    (line(1, 2, [4096, 0, 0, 0, 0, 0], off=1), "bad_checksum"),
    (line(1, 2, [-1, 0, 0, 0, 0, 0]), "malformed"),
    ("# ble conn=0", "status"),
    ("", "empty"),
    (None, "empty"),
    ("INS,99999999999999999999,0,0,0,0,0,0,0,0", "malformed"),
]


def lines_of(spark, values):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "session_id string, line_no long, value string")


def test_parse_table(spark):
    got = fx.parse_frames(lines_of(spark, [v for v, _ in CASES])).orderBy("line_no").collect()
    assert [r.status for r in got] == [s for _, s in CASES]
    assert got[0].s3 == 150 and got[3].s0 is None


def test_encode_is_the_inverse(spark):
    f = fx.parse_frames(lines_of(spark, [line(7, 70000, S)]))
    assert fx.encode_frames(f.drop("value")).first()["value"] == line(7, 70000, S)


def test_streaming_parser_agrees(spark):
    from strideforge.streaming.live import parse

    assert [parse(v or "")[0] for v, _ in CASES] == [s for _, s in CASES]


def account(spark, values):
    return link.link_accounting(fx.parse_frames(lines_of(spark, values))).orderBy("frame_idx").collect()


def test_lost_corrupt_and_restart(spark):
    z = [0] * 6
    v = [line(65534, 0, z), line(65535, 10000, z), line(0, 20000, z), line(2, 40000, z), line(3, 50000, z, off=1), line(4, 60000, z)]
    v += [line(4, 70000, z), line(5, 80000, z), line(0, 0, z), line(1, 10000, z)]
    got = account(spark, v)
    assert [r.lost for r in got] == [0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert [r.last_gap for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert [r.seq_break for r in got] == [False, False, False, True, False, True, False, False, False]
    assert [r.timing_break for r in got] == [False] * 9
    assert [r.reset for r in got] == [False] * 7 + [True, False]
    assert [r.epoch for r in got] == [0] * 7 + [1, 1]


def test_timing_edge(spark):
    z = [0] * 6
    assert [r.timing_break for r in account(spark, [line(0, 0, z), line(1, 13000, z), line(2, 26001, z)])] == [False, False, True]


def test_centre_of_pressure(spark):
    rows = [(9, 0, 0, 0, 0, 0), (5, 5, 5, 5, 5, 5), (7, 7, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"s{k} int" for k in range(6)))
    got = [(r.cop_x, r.cop_y) for r in fx.cop(df).orderBy("i").collect()]
    assert got[0] == pytest.approx((33.0 / 274, 50.8 / 274))
    assert got[1] == pytest.approx((0.177676, 0.545377), abs=1e-6)
    assert got[2] == pytest.approx((0.152920, 0.185401), abs=1e-6)
    assert got[3] == (None, None)


def test_representations(spark):
    df = spark.createDataFrame([(0, 1000, 4095, 4094, 5, 6)], ", ".join(f"s{k} int" for k in range(6)))
    c, g = fx.transform(df, "conductance").first(), fx.transform(df, "gain_matched", {}).first()
    assert list(c) == list(g) and c.s0 == 0 and c.s2 == c.s3 == 4094.0
    u = fx.cop(fx.transform(df, "gain_matched", {i: 2.0 for i in range(6)})).first()
    assert u.cop_x == pytest.approx(fx.cop(fx.transform(df, "conductance")).first().cop_x)
    with pytest.raises(ValueError):
        fx.transform(df, "other")
    with pytest.raises(ValueError):
        fx.resolve_representation({"representation": "gain_matched"})
    with pytest.raises(ValueError):
        fx.resolve_representation({})


def test_parse_kv(spark):
    got = fx.parse_kv(lines_of(spark, ["# ble conn=1 mtu=247", "source=file valid=3", "INS,1"])).collect()
    assert [r.kv for r in got] == [{"conn": "1", "mtu": "247"}, {"source": "file", "valid": "3"}]


def test_verdicts(spark):
    base = dict(n_malformed=0, n_bad_checksum=0, resets=0, n_valid=10, lost=0, loss_pct=0.0, seq_breaks=0, timing_breaks=0)
    rows = [base, base | {"n_malformed": 1}, base | {"resets": 1}, base | {"n_valid": 0}, base | {"lost": 1, "loss_pct": 1.0}, base | {"timing_breaks": 1}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], ["i", *base])
    assert [r.verdict for r in link.capture_verdict(df).orderBy("i").collect()] == ["ok", "corruption", "reset", "no_frames", "loss", "timing"]
    assert [r.verdict for r in link.capture_verdict(df, "ble").orderBy("i").collect()][4] == "ok"


def test_student_tail():
    assert t_two_sided(0.5, 20) == pytest.approx(0.0247, abs=2e-4)
    assert t_two_sided(0.0, 10) == pytest.approx(1.0)
    assert t_two_sided(1.0, 10) == 0.0 and t_two_sided(None, 3) is None
    assert math.isclose(t_two_sided(0.9, 5), 0.0374, abs_tol=2e-4)


def test_reassembled_chunks(spark):
    from strideforge.sources.logs import reassemble_lines

    df = spark.createDataFrame([("a", 1, "ab\nc"), ("a", 2, "d\n\n"), ("a", 3, "tail")], "session_id string, chunk_no long, bytes string")
    assert [r.value for r in reassemble_lines(df).orderBy("line_no").collect()] == ["ab", "cd"]


def test_empty_input(spark):
    none = spark.createDataFrame([], "session_id string, line_no long, value string")
    assert link.link_accounting(fx.parse_frames(none)).count() == 0
