"""Shared small helpers of the training-data operators."""

import tempfile
import uuid

from pyspark.sql import functions as F

#: The key of a document whose doc_id is null.
NULL_ID = -(2**63)


def shared_dir(spark):
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, a new local folder if the master is local.

    On a cluster a folder of the driver's own machine would lose what the executors write, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Rows of an Arrow batch while a table is written: whole texts pass through Python, and a task holds a batch on both sides.
BATCH_ROWS = 1000


#: Spark's setting that removes the shuffle files of an execution at its end; else they stay until the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name, batch_rows=BATCH_ROWS, release=False):
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    The session's size of Arrow batches is lowered to batch_rows for this write and put back after it. release: the shuffle
    files of this write are removed as soon as it has ended, as nothing reads them any more.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before, kept = int(spark.conf.get(key)), spark.conf.get(RELEASE, "false")
    spark.conf.set(key, str(min(before, batch_rows) if before > 0 else batch_rows))
    spark.conf.set(RELEASE, "true" if release else kept)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, str(before))
        spark.conf.set(RELEASE, kept)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs, text="text"):
    """doc_id and text (null: empty) with the key (_id, _th) that names a row.

    Rows with equal doc_id and equal text are one document; a null doc_id is an id of its own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "doc_id", t.alias("text"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64(t).alias("_th")
    )


def fresh(df, name):
    """The name, with marks behind it where df has a column of that name already."""
    while name in df.columns:
        name += "_"
    return name


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released():
    """Give memory that a worker no longer uses back to the system: executors keep their workers from stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def slices(batch, column, limit=2 << 20):
    """Cut an Arrow batch into runs of rows of about ``limit`` bytes by a column of texts or of sizes: bounds a task's memory."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = batch.column(column)
    size = size if pa.types.is_integer(size.type) else pc.binary_length(size)
    size = np.asarray(pc.fill_null(size, 0)).astype(np.int64) + 16
    piece = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, n]):
        yield batch.slice(int(a), int(b - a))
    released()


def ascii_words(texts):
    """Words [^\\x20\\x09-\\x0D]+ of a string array (null: none): codes into the distinct words, offsets by row, distinct words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), offsets.astype(np.int64), coded.dictionary


def lower_ascii(texts):
    """The string array (null: empty) with A-Z in lower case and all other bytes as they are."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))


def mix64(x):
    """A bijection of uint64 arrays (a murmur-type finaliser)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed(strings, seed=0):
    """64-bit hashes of an Arrow array of strings."""
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in strings.to_pylist()), np.uint64, len(strings))


def least_hashes(rows, h, n):
    """Rows with the n smallest values of the 64-bit hash column h (about n of them or all, if there are fewer).

    A first cut by the share of the hash range leaves about 2 n rows, so the sort gathers a bounded number from any input.
    """
    total = rows.count()
    if total > 4 * n:
        rows = rows.filter(F.col(h) < int((2 * n / total - 0.5) * 2**64))
    return rows.orderBy(h, *[c for c in rows.columns if c != h]).limit(n)


#: Bits for each key, and the most of them all (32 MB), of the broadcast that tells rows which cannot meet a key.
KEY_BITS, MOST_BITS, BUCKET_BITS = 16, 1 << 28, 1 << 15


def parted(rows, keys):
    """rows(_id, _th, ...) in two: those whose key may be in keys(_id, _th), and those whose key is not.

    Only the first need a shuffle to meet keys, a written table of distinct keys: all rows that have a match, and about one in
    KEY_BITS of the others. Bits at the keys' hashes are broadcast in buckets of 4 KB. Beyond MOST_BITS more of the others
    are among the first; the second never hold a match.
    """
    n = min(MOST_BITS, max(1, -(-keys.count() * KEY_BITS // BUCKET_BITS)) * BUCKET_BITS)
    at = F.pmod(F.xxhash64("_id", "_th"), F.lit(n)) + 1
    bucket, bit, bits = (fresh(rows, c) for c in ("_bucket", "_bit", "_bits"))
    there = keys.select(F.bitmap_bucket_number(at).alias(bucket), F.bitmap_bit_position(at).alias(bit)).repartition(bucket)
    there = there.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bits))
    marked = rows.withColumns({bucket: F.bitmap_bucket_number(at), bit: F.bitmap_bit_position(at)}).join(F.broadcast(there), bucket, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    return marked.filter(may).select(*rows.columns), marked.filter(~may).select(*rows.columns)


#: Ids up to this number (8 bytes each) are broadcast to pick rows; beyond it the rows are joined by a shuffle.
MAX_BROADCAST = 200_000


def without(docs, found):
    """docs less the rows whose doc_id (null included) and text are those of a row of found(_id, _th), distinct and written."""
    few = found.count() <= MAX_BROADCAST
    t = F.coalesce("text", F.lit(""))
    here = (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("_id")) & (F.xxhash64(t) == F.col("_th"))
    return docs.join(F.broadcast(found) if few else found, here, "left_anti")
