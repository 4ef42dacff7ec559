import base64
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideforge.llm import ivfpq, warc
from strideforge.llm.components import connected

PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark):
    rnd = random.Random(1)
    big = "".join(rnd.choice("abcé\r\n WARC/1.1") for _ in range(9000))
    rows = [(i, f"http://h/{i}", h, "clash") for i, h in enumerate([big, "x", None, "", "x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "x" * 100, "\r\n\r\n"])]
    rows += [(7, "http://h/7", "\r\n\r\n", "clash"), (None, None, "lone", "c")]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), segment_bytes=700, chunk_bytes=64, records_per_file=3).collect()
    least = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        least[p] = min(least.get(p, 99), 99 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        revisit = i is not None and least[p] != i
        want.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", str(least[p]) if revisit else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out) == sorted(want)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_of_other_makes(tmp_path, spark):
    block = lambda k, body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    one = lambda k, body: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Target-URI: http://h/%d\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, k, len(block(k, body)), block(k, body))
    bodies = [b"a" * 3_000_000, b"", b"\r\n\r\nWARC/1.0", "é".encode()]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(one(k, b)) for k, b in enumerate(bodies)))
    (tmp_path / "plain.warc").write_bytes(b"".join(one(k, b) for k, b in enumerate(bodies)))
    got = sorted((r.url, bytes(r.payload)) for r in warc.read_pages(spark, str(tmp_path)).collect())
    assert got == sorted((f"http://h/{k}", b) for k, b in enumerate(bodies) for _ in range(2))
    with pytest.raises(ValueError, match="early"):
        list(warc.records(gzip.compress(one(1, b"abc"))[:-12]))
    with pytest.raises(ValueError, match="early"):
        list(warc.records(one(1, b"abc")[:-9]))


def test_revisits_name_the_record_of_their_response(spark, tmp_path):
    rows = [(i, "u", h, "") for i, h in [(1, "x"), (2, "x"), (3, "y"), (3, "y"), (5, "y"), (6, "z"), (7, "z" * 5000), (8, "z" * 5000)]]
    warc.write_archive(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w", segment_bytes=512)
    heads = [h for p in (tmp_path / "w").glob("*.gz") for h, _ in warc.records(p.read_bytes())]
    ids = [h["warc-record-id"] for h in heads]
    responses = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert len(set(ids)) == len(ids) and len(responses) == 5
    assert all(h["warc-refers-to"] in responses for h in heads if h["warc-type"] == "revisit")
    assert all(h["warc-segment-origin-id"] in responses for h in heads if h["warc-type"] == "continuation")


def test_least_bytes(spark):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), least_bytes=5).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_broken_segments_are_errors(spark):
    rows = [("a", "response", 1, "u", "d", None, None, 1, None, bytearray(b"xx")), ("b", "continuation", None, None, "", None, "a", 3, 4, bytearray(b"yy"))]
    with pytest.raises(Exception, match="segments missing"):
        warc.reassembled(spark.createDataFrame(rows, warc.RECORD)).collect()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"hello world", 4)) == b"hello world"


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[900:1300] = x[900]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(3000, None), (3100, [0.0] * 24), (3200, [float("nan")] + [1.0] * 23), (3300, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ivfpq.search(df, F.pmod("vec_id", F.lit(100)) == 0, lists=16).collect()
    hit = 0
    d = x.astype(float)
    for q in range(0, 1500, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), dist)) if i != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - dist[r.vec_id]) < 1e-9 for r in mine)
        hit += len(set(want) & {r.vec_id for r in mine})
        if q in (900, 1000, 1100, 1200):
            assert [r.vec_id for r in mine] == want
    assert hit >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 100))
    assert ivfpq.search(df.limit(0), F.lit(True)).count() == 0
    few = ivfpq.search(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3


def recall(spark, x, step, **settings):
    """Share of the true 10 nearest that the search finds."""
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("of the caller"))
    for r in ivfpq.search(df, F.pmod("vec_id", F.lit(step)) == 0, **settings).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = n = 0
    for q in range(0, len(x), step):
        dist = ((x - x[q]) ** 2).sum(1)
        want = {int(i) for i in np.lexsort((np.arange(len(x)), dist)) if i != q and np.any(x[i])} if len(x) < 20 else [int(i) for i in np.argsort(dist, kind="stable") if i != q][:10]
        hit, n = hit + len(set(want) & got.get(q, set())), n + len(want)
    return hit / n


def test_recall_beside_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 24))
    x[1000:3500] = x[1000] + rng.normal(size=(2500, 24)) * 0.001
    x[4000:4400] = x[4000] + rng.normal(size=(400, 24)) * 0.05
    assert recall(spark, x, 50) >= 0.95


def test_clustered_data_visits_few_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(40, size=8000)] + rng.normal(size=(8000, 24)) * 0.25
    assert recall(spark, x, 80) >= 0.95
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    model = ivfpq.fit(df)
    assert model[2] <= 0.15 * len(model[0])
    n = ivfpq.visits(df.filter("vec_id % 80 = 0"), spark.sparkContext.broadcast(model)).count()
    assert n == 100 * model[2]


def test_noise_visits_more_lists_than_clusters():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    coarse = ivfpq.kmeans(x, 50)
    wide = ivfpq.probes_for(x, ivfpq.nearest(x, coarse), coarse)
    assert 10 < wide <= 50
    assert ivfpq.probes_for(x[:1], np.zeros(1, int), coarse[:1]) == 1


GIVEN = "/root/testdata/sf0.01/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given table is not there")
def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet(GIVEN).filter("embedding is not null").orderBy("vec_id").select("embedding").collect()
    assert recall(spark, np.array([r.embedding for r in rows], float), 5) >= 0.9


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 101 + i) for i in range(50)] + [(7, 7), (100, 101)]
    rnd.shuffle(edges)
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {100 + i: 100 for i in range(51)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
