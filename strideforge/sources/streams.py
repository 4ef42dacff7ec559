"""The seam of live lines: one function over several sources, each giving session_id, line_no, value and, if known, arrival_ts.

``json`` reads files that carry all columns; ``log`` follows saved or growing text logs, one session a file; ``kafka`` takes the
lines of a topic, one session a key. Past the seam nothing knows where lines came from. Files cannot stall: replays of ``log`` go
without a watch for silence (``stall_s=None``), as their lines carry no time of arrival.
"""

import re

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LOG = "session_id string, line_no long, value string"
#: Bytes that one task reads of a log, bytes read at a time, and rows of an Arrow batch.
PIECE, CHUNK, ROWS = 64 << 20, 1 << 20, 20_000


def _store(path):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _last_line_end(store, path, size):
    """The place after the last line feed of a file's first size bytes: a line that is still being written waits."""
    with store.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - CHUNK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Piece(InputPartition):
    """Byte ranges of logs that one task reads: the lines that begin in them."""

    def __init__(self, ranges):
        self.ranges = ranges


def lines_of(store, path, begin, end):
    """(place, line) of the lines of a file that begin at begin <= place < end, begin being the start of a line or inside one."""
    with store.open_input_file(path) as f:
        at = begin
        if begin > 0:
            f.seek(begin - 1)
            while True:  # a line that began before belongs to the piece before
                data = f.read(CHUNK)
                if not data:
                    return
                cut = data.find(b"\n")
                if cut >= 0:
                    at = f.tell() - len(data) + cut + 1
                    break
        f.seek(at)
        rest = b""
        while at < end:
            data = f.read(CHUNK)
            if not data:
                if rest:
                    yield at, rest
                return
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                if at >= end:
                    return
                yield at, line
                at += len(line) + 1


class LogReader(DataSourceStreamReader):
    """Offsets are a place in each file; what a file gained since is read, in pieces, by the tasks."""

    def __init__(self, options):
        self.path = options["path"]
        self.pattern = re.compile(options.get("pattern", r"\.(log|txt)$"))
        self.key = re.compile(options.get("session", r"(.+)"))
        self.piece = int(options.get("piecebytes", PIECE))
        self.finished = options.get("finished", "false") == "true"

    def initialOffset(self):
        return {}

    def latestOffset(self):
        from pyarrow import fs

        store, top = _store(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        logs = [f for f in found if f.type == fs.FileType.File and self.pattern.search(f.path)]
        return {f.path: f.size if self.finished else _last_line_end(store, f.path, f.size) for f in logs}

    def partitions(self, start, end):
        ranges = [(p, a, min(a + self.piece, b)) for p, b in sorted(end.items()) for a in range(start.get(p, 0), b, self.piece)]
        groups, size = [], self.piece
        for r in ranges:
            if size + r[2] - r[1] > self.piece:
                groups.append([])
                size = 0
            groups[-1].append(r)
            size += r[2] - r[1]
        return [Piece(g) for g in groups]

    def read(self, partition):
        import pyarrow as pa

        store, _ = _store(self.path)
        schema = pa.schema([("session_id", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
        for path, begin, end in partition.ranges:
            m = self.key.search(path)
            session, places, values = m[1] if m else path, [], []
            for at, line in lines_of(store, path, begin, end):
                places.append(at)
                values.append(line.decode("utf-8", "replace").rstrip("\r"))
                if len(places) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([session] * len(places)), pa.array(places), pa.array(values)], schema=schema)
                    places, values = [], []
            if places:
                yield pa.RecordBatch.from_arrays([pa.array([session] * len(places)), pa.array(places), pa.array(values)], schema=schema)

    def commit(self, end):
        pass


class LogSource(DataSource):
    """``format("frame_log")``: text logs below a folder; line_no is the byte at which the line begins.

    Options: pattern (of the files' paths), session (a group that names the session), finished (take a last line without a line
    feed too), pieceBytes.
    """

    @classmethod
    def name(cls):
        return "frame_log"

    def schema(self):
        return LOG

    def streamReader(self, schema):
        return LogReader(self.options)


def kafka_lines(records):
    """Lines of records as Spark's Kafka source gives them: a session is a key, its lines are in one partition's order."""
    return records.select(F.col("key").cast("string").alias("session_id"), F.col("offset").cast("long").alias("line_no"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrival_ts"))


def line_stream(spark, where, source="json", **options):
    """A stream of lines from ``where``: a folder of JSON files or of text logs, or a Kafka topic (options: those of the source)."""
    if source == "json":
        reader = spark.readStream.schema(f"{LOG}, arrival_ts timestamp")
        return reader.options(**options).json(where)
    if source == "log":
        spark.dataSource.register(LogSource)
        return spark.readStream.format("frame_log").options(**options).load(where)
    if source == "kafka":
        return kafka_lines(spark.readStream.format("kafka").options(subscribe=where, **options).load())
    raise ValueError(f"no source {source!r}: json, log or kafka")
