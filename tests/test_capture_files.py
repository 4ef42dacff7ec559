"""Captures of a fleet: the number of files follows the tasks, not the sessions."""

from pyspark.sql import functions as F

from strideforge.plans import model_queries as mq
from strideforge.schemas import CHANNELS
from strideforge.sources import logs


def test_captures_come_back_from_few_files(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(6000).select((i % 200).alias("session_id"), F.floor(i / 200).alias("frame_idx"), (i % 65536).cast("int").alias("seq"), (i * 10_000).alias("ts_us"), *[(i % (c + 7)).cast("int").alias(c_) for c, c_ in enumerate(CHANNELS)])
    logs.write_captures(rows.repartition(3, "session_id"), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").rglob("*.csv"))) <= 3
    back = logs.load_captures(spark, str(tmp_path / "c"))
    key = ["session_id", "frame_idx", "seq", "ts_us", *CHANNELS]
    told = rows.withColumn("session_id", F.col("session_id").cast("string")).select(key)
    assert sorted(back.select(key).collect()) == sorted(told.collect())


def test_the_query_makes_no_file_for_each_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mq, "shared", lambda spark: str(tmp_path / "q"))
    found = mq.Q["io2_io3_io12_captures"](spark, "/root/testdata/sf0.01")
    sessions = found.count()
    assert sessions > 50 and len(list((tmp_path / "q").rglob("*.csv"))) < sessions / 4
