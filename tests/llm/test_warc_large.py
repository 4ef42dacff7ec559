"""Archives with a payload that half of the pages share, a very long page, and files read piece by piece."""

import gzip
import time

from pyspark.sql import functions as F

from strideforge.llm import warc


def test_a_payload_in_half_of_the_rows(spark):
    hot = "<p>" + "the same page " * 50
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    found = warc.round_trip(pages.repartition(6))
    n = {r.record_type: r["count"] for r in found.groupBy("record_type").count().collect()}
    assert n == {"response": 2001, "revisit": 1999}
    assert [r.page_id for r in found.filter("record_type = 'response' and page_id % 2 = 0").collect()] == [0]
    assert found.filter("record_type = 'revisit'").select("refers_to", "payload_bytes").distinct().collect() == [(0, len(hot))]


def test_payloads_do_not_meet_by_digest(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "materialize", lambda df, name: seen.append((name, df.columns)) or df)
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert {n for n, _ in seen} == {"warc-pages", "warc-shared", "warc-special"} and all("payload" not in c for _, c in seen)


def test_repeated_rows_among_revisits(spark):
    rows = [(3, "u", "x")] * 2 + [(5, "u", "x")] * 3 + [(7, "u", "y")] * 2 + [(None, "u", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted(
        [("3", "response", None)] * 2 + [("5", "revisit", 3)] * 3 + [("7", "response", None)] * 2 + [("None", "revisit", 3)]
    )


def test_a_very_long_page_is_joined_in_linear_time(spark):
    def took(mb):
        pages = spark.createDataFrame([(1, "u", "ab12" * (mb << 18))], "page_id long, url string, html string")
        began = time.time()
        row = warc.round_trip(pages).first()
        assert row.payload_bytes == mb << 20
        return time.time() - began

    took(1)
    assert took(64) < 60


def test_files_in_pieces(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\nX-Page-Id: %d\r\n\r\n%b\r\n\r\n"
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i % 26]) * (i * 5000) for i in range(60)]
    members = [gzip.compress(record % (i, len(b), i, b)) for i, b in enumerate(blocks)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "two.warc").write_bytes(b"".join(record % (i + 100, len(b), i + 100, b) for i, b in enumerate(blocks)))
    for whole in (1 << 30, 0):
        got = {r.page_id: bytes(r.block) for r in warc.read_records(spark, str(tmp_path), whole=whole).collect()}
        assert got == {i + k: b for k in (0, 100) for i, b in enumerate(blocks)}
