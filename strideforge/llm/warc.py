"""WARC archives: writing pages as records, and reading archives back with their segments joined.

Writing: a page is an HTTP response with a chunked body in a record of its own; a block longer than ``segment_bytes`` goes
on in continuation records with the origin's id and their segment numbers, the last one with the total length. Of pages
with equal payloads (SHA-1) of at least ``least_bytes`` bytes the one with the smallest page_id is written in full, the
others as revisits of it without a payload, which name its record (WARC-Refers-To). Records go to compressed text files through
Spark's writer, at most ``records_per_file`` to a file, in the shared folder or a path of the caller's; that writer zips a file as
a whole, not record by record.

Reading: files of the names ``pattern`` (those of the writer and .warc files, zipped in one or in many members or not) are unzipped
piece by piece (those of more than ``WHOLE`` bytes are read so, too), records are cut from them by their Content-Length; segmented ones are grouped by origin id (a group is one
payload), ordered by segment number, and their total length is verified; then the chunked framing is decoded. A revisit
takes its payload's size from the response that it refers to, by a join. Broken archives (a missing or repeated segment, a
wrong length, bad framing) are errors, not rows.

Null html counts as an empty payload; empty payloads are payloads like others. Repeated rows with the least page_id of
their payload are all responses. A null page_id comes after all others and has no revisits. Other columns are ignored. An
empty table gives an archive without records, and no rows.
"""

import uuid

from pyspark.sql import functions as F

from strideforge.llm.common import materialize, shared_dir, slices, table

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32_768, 4_096, 4_000
LAST = 2**63 - 1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "id string, type string, page_id long, uri string, digest string, refers_to long, origin string, segment int, total long, block binary"


def base32_sha1(binary):
    """Bare upper-case base32 of the SHA-1 of a binary column: four runs of eight letters of five bits."""
    h = F.sha1(binary)
    runs = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*runs)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload, size):
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body):
    """The payload of a chunked body; trailers are dropped, anything else that is wrong is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends early")
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        at = end + 2
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(body[at : at + n])
        at += n + 2


def write_archive(pages, path, least_bytes=0, segment_bytes=SEGMENT_BYTES, chunk_bytes=CHUNK_BYTES, records_per_file=RECORDS_PER_FILE):
    """Write pages(page_id, url, html) as WARC records under path."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.coalesce("page_id", F.lit(LAST)).alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("serial", F.monotonically_increasing_id())
    # what a page's record is follows from its digest and page: only these keys meet by digest, never the payloads
    pages_of = rows.select("digest", "page_id", "serial", F.octet_length("payload").alias("n")).groupBy("digest", "page_id")
    pages_of = materialize(pages_of.agg(F.count("*").alias("copies"), F.min("serial").alias("one"), F.max("n").alias("n")), "warc-pages")
    shared = pages_of.groupBy("digest").agg(F.count("*").alias("pages"), F.max("n").alias("n"), F.min(F.struct("page_id", "one", "copies")).alias("least"))
    shared = materialize(shared.filter((F.col("pages") > 1) & (F.col("n") >= least_bytes)).select("digest", "least"), "warc-shared")
    later = pages_of.join(shared, "digest", "left").withColumn("refers", F.when(F.col("least.page_id") != F.col("page_id"), F.col("least.page_id")))
    # a record is named by its page and digest; where rows are repeated, by a serial number as well
    special = later.filter((F.col("copies") > 1) | F.col("refers").isNotNull())
    special = materialize(special.select("digest", "page_id", (F.col("copies") > 1).alias("repeated"), "refers", "least"), "warc-special")
    rows = rows.join(special, ["digest", "page_id"], "left")
    name = lambda page, one, more: F.concat(F.lit("urn:page:"), F.col(page).cast("string"), F.lit(":"), "digest", F.when(more, F.concat(F.lit(":"), F.col(one).cast("string"))).otherwise(""))
    other = F.when(F.col("refers").isNotNull(), name("refers", "least.one", F.col("least.copies") > 1))
    rows = rows.withColumns({"own": name("page_id", "serial", F.coalesce("repeated", F.lit(False))), "other": other})

    def run(batches):
        import pyarrow as pa

        def record(own, page, url, digest, other, block):
            kind = "response" if other is None else "revisit"
            parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)] or [b""]
            for k, part in enumerate(parts, 1):
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {kind if k == 1 else 'continuation'}",
                    f"WARC-Record-ID: <{own}{f'/{k}' if k > 1 else ''}>",
                    "WARC-Date: 1970-01-01T00:00:00Z",
                    f"Content-Length: {len(part)}",
                ]
                if k == 1:
                    head.append(f"X-Page-Id: {page}")
                    if url is not None:
                        head.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
                    head.append(f"WARC-Payload-Digest: sha1:{digest}")
                    if other is not None:
                        head.append(f"WARC-Refers-To: <{other}>")
                        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                if len(parts) > 1:
                    head.append(f"WARC-Segment-Number: {k}")
                    if k > 1:
                        head.append(f"WARC-Segment-Origin-ID: <{own}>")
                    if k == len(parts):
                        head.append(f"WARC-Segment-Total-Length: {len(block)}")
                yield "\r\n".join(head).encode() + b"\r\n\r\n" + part

        for whole in batches:
            for batch in slices(whole, "payload"):
                d = batch.to_pydict()
                out = []
                for own, page, url, digest, other, payload in zip(*(d[c] for c in ("own", "page_id", "url", "digest", "other", "payload"))):
                    block = HTTP + chunked(payload, chunk_bytes) if other is None else HTTP
                    out += record(own, page, url, digest, other, block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    body = F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b""))
    lean = rows.select("own", "page_id", "url", "digest", "other", body.alias("payload"))
    records = lean.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.mode("append").text(path)


#: Bytes that are unzipped at a time.
PIECE = 1 << 20


def unzipped(source):
    """The bytes of an archive (bytes, or a file to read from) in pieces: of all members of a zipped one, or as they are."""
    import io
    import zlib

    source = io.BytesIO(source) if isinstance(source, bytes) else source
    data = source.read(PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(PIECE)
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            if not data and not (data := source.read(PIECE)):
                raise ValueError("a zipped archive ends early")
            yield d.decompress(data, PIECE)
            data = d.unconsumed_tail
        data = d.unused_data or source.read(PIECE)


def records(data):
    """(headers in lower case, block) of the records in the bytes of an archive, compressed or not."""
    held, more = bytearray(), unzipped(data)

    def upto(n):
        """Whether n bytes are there, unzipped as needed."""
        while len(held) < n:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while upto(2):
        if held[:2] == b"\r\n":
            del held[:2]
            continue
        at = 0
        while (stop := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            if not upto(at + 1):
                break
        if held[:5] != b"WARC/" or stop < 0:
            raise ValueError("not a WARC record")
        head = {}
        for line in bytes(held[:stop]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode()
        end = stop + 4 + int(head["content-length"])
        if not upto(end):
            raise ValueError("a record ends early")
        yield head, bytes(held[stop + 4 : end])
        del held[:end]


#: Names of the files that are read; files up to so many bytes are values, larger ones are read piece by piece inside a task.
PATTERN, WHOLE = "*{.txt,.warc}*", 256 << 20


def read_records(spark, path, pattern=PATTERN, whole=WHOLE):
    """All records of the archives under path: one row each, segments not yet joined."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        number = lambda h, k: int(h[k]) if h.get(k, "").isdecimal() else None
        page = lambda name: int(name.split(":")[2]) if name.startswith("<urn:page:") else None
        from strideforge.sources.streams import _store

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size, source = [], 0, batch.column("content")[i].as_py()
                if source is None:
                    store, place = _store(batch.column("path")[i].as_py())
                    source = store.open_input_file(place)
                for h, block in records(source):
                    rows.append(
                        (
                            h["warc-record-id"], h["warc-type"], number(h, "x-page-id"), h.get("warc-target-uri"),
                            h.get("warc-payload-digest", "").removeprefix("sha1:"), page(h.get("warc-refers-to", "")), h.get("warc-segment-origin-id"),
                            number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), block,
                        )
                    )
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    small = files().filter(F.col("length") <= whole).select("path", "content").mapInArrow(run, RECORD)
    large = files().filter(F.col("length") > whole).select("path").repartition("path")  # names only
    return small.unionByName(large.withColumn("content", F.lit(None).cast("binary")).mapInArrow(run, RECORD))


def reassembled(rows):
    """Records with whole blocks: segments joined in order, their numbers and total length verified."""
    whole = rows.filter("segment is null").select("id", "type", "page_id", "uri", "digest", "refers_to", "block")
    parts = rows.filter("segment is not null").groupBy(F.coalesce("origin", "id").alias("id")).agg(
        *[F.max(c).alias(c) for c in ("page_id", "uri", "digest", "refers_to", "total")],
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    names = whole.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                parts = one.column("parts").flatten()
                numbers, blocks = parts.field("segment").to_pylist(), parts.field("block").to_pylist()
                block = b"".join(blocks)
                if numbers != list(range(1, len(numbers) + 1)) or len(block) != one.column("total")[0].as_py():
                    raise ValueError(f"segments missing or of wrong length: {one.column('id')[0].as_py()}")
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names[:-1]), pa.array([block], pa.binary())], names)

    joined = parts.select(*names[:-1], "total", "parts").mapInArrow(run, whole.schema)
    return whole.unionByName(joined)


def read_pages(spark, path):
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_digest of the archives under path."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "block"):
                out = []
                for kind, block in zip(batch.column("type").to_pylist(), batch.column("block").to_pylist()):
                    head, _, body = block.partition(b"\r\n\r\n")
                    chunks = b"\r\ntransfer-encoding: chunked" in head.lower()
                    out.append(None if kind == "revisit" else unchunked(body) if chunks else body)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "uri", "type", "refers_to", "digest")), pa.array(out, pa.binary())], names)

    names = ["page_id", "url", "record_type", "refers_to", "stated_digest", "payload"]
    schema = "page_id long, url string, record_type string, refers_to long, stated_digest string, payload binary"
    return reassembled(read_records(spark, path)).select("page_id", "uri", "type", "refers_to", "digest", "block").mapInArrow(run, schema)


def resolved(pages):
    """Pages read from archives with payload_bytes and payload_digest, for revisits those of the response that they name.

    A response whose payload does not have the stated digest is an error, and so is a revisit of a page that is not there.
    """
    full = pages.filter("record_type <> 'revisit'")
    digest = base32_sha1(F.col("payload"))
    wrong = F.raise_error(F.concat(F.lit("wrong payload digest of page "), F.col("page_id").cast("string")))
    full = full.select(
        "page_id", "url", "record_type", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(digest == F.col("stated_digest"), digest).otherwise(wrong).alias("payload_digest"),
    )
    known = full.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = pages.filter("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to", "stated_digest")
    absent = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("refers_to").cast("string")))
    again = again.join(known, ["refers_to", "stated_digest"], "left").select(
        "page_id", "url", "record_type", "refers_to",
        F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(absent.cast("long")).alias("payload_bytes"),
        F.col("stated_digest").alias("payload_digest"),
    )
    return full.unionByName(again).withColumn("page_id", F.when(F.col("page_id") != LAST, F.col("page_id")))


def round_trip(pages, path=None, **settings):
    """Write the pages to a new archive and read it back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **settings)
    return resolved(read_pages(spark, path))


def op7_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, min(page_id) AS least FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM p JOIN g USING (h)
"""
}
