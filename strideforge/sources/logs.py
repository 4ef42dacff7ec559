"""Sources and sinks of frames: text logs, capture CSV, chunks, predictions."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strideforge.schemas import CAPTURE_CSV, CHANNELS


def _in_file_order(rows):
    """rows(session_id, _block, _at, ...) numbered from 0 in the order of their file: by block, then as the task read them."""
    w = Window.partitionBy("session_id").orderBy("_block", "_at")
    return F.row_number().over(w) - 1


def read_frame_log(spark, path):
    """Lines of saved logs in order: session_id (the file), line_no, value; what follows the last line feed is no line if it is empty.

    Files are read line by line and split at any size; lines are numbered in the order of their place in the file.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    return rows.select("session_id", _in_file_order(rows).cast("long").alias("line_no"), F.trim("value").alias("value"))


def read_capture_csv(spark, path, schema=CAPTURE_CSV):
    """Capture CSV files; a header other than the schema's is refused. frame_idx follows the rows of a file."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    rows = raw.select(F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), *schema.names)
    return rows.withColumn("frame_idx", _in_file_order(rows).cast("long")).drop("_block", "_at")


def load_sessions(spark, paths, key=r"([^/]+)\.csv$"):
    """Many captures in one read, with the session taken from the file's name."""
    frames = read_capture_csv(spark, paths)
    return frames.withColumn("session_id", F.regexp_extract("session_id", key, 1))


def write_capture(frames, path, format="csv"):
    """Frames by session, in order, under session_id=<id> folders."""
    out = frames.select("session_id", "frame_idx", "seq", "ts_us", *CHANNELS).repartition("session_id").sortWithinPartitions("session_id", "frame_idx")
    out.drop("frame_idx").write.mode("overwrite").partitionBy("session_id").option("header", True).format(format).save(path)


def write_captures(frames, path):
    """Many captures as CSV: a file for each task, its sessions one after another, told by the column session_id; frames in order.

    A folder for each session, as ``write_capture`` makes, costs several calls to the file system a session when written, when listed
    and when read; here the number of files follows the number of tasks that the frames are dealt to.
    """
    out = frames.select("session_id", "frame_idx", "seq", "ts_us", *CHANNELS).sortWithinPartitions("session_id", "frame_idx")
    out.drop("frame_idx").write.mode("overwrite").option("header", True).csv(path)


def load_captures(spark, path):
    """The frames of ``write_captures``: session_id (text), frame_idx by the order of the session's rows, and the fields of a capture."""
    schema = StructType([StructField("session_id", StringType()), *CAPTURE_CSV.fields])
    raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    rows = raw.select(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), *schema.names)
    return rows.withColumn("frame_idx", _in_file_order(rows).cast("long")).drop("_block", "_at")


def write_predictions(rows, path, format="csv"):
    rows.write.mode("overwrite").option("header", True).format(format).save(path)


def reassemble_lines(chunks):
    """Whole lines of notification chunks(session_id, chunk_no, bytes): the trailing partial line and blank pieces are dropped.

    Each chunk is cut at its line feeds; a piece belongs to the line after the feeds before it. Only the pieces of one line
    meet, never a whole session.
    """
    w = Window.partitionBy("session_id").orderBy("chunk_no")
    cut = chunks.withColumn("_p", F.split("bytes", "\n", -1)).withColumn("_n", F.size("_p") - 1)
    cut = cut.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.withColumn("_all", F.sum("_n").over(Window.partitionBy("session_id")))
    pieces = cut.select("session_id", "chunk_no", "_before", "_all", F.posexplode("_p").alias("_i", "piece"))
    pieces = pieces.select("session_id", "chunk_no", "piece", (F.col("_before") + F.col("_i")).alias("_line"), "_all").filter(F.col("_line") < F.col("_all"))
    joined = pieces.groupBy("session_id", "_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "piece"))), lambda x: x["piece"]), "").alias("value"))
    whole = joined.select("session_id", "_line", F.trim("value").alias("value")).filter("value <> ''")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("_line")) - 1
    return whole.select("session_id", number.cast("long").alias("line_no"), "value")


def line_stream(spark, path, max_files=None):
    """The streaming twin: rows of (session_id, line_no, value, arrival_ts) as JSON files arrive. Other sources: ``streams.line_stream``."""
    from strideforge.sources import streams

    return streams.line_stream(spark, path, **({"maxFilesPerTrigger": max_files} if max_files else {}))
