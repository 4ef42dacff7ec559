"""Near-duplicate documents by circulant MinHash.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set holds its distinct 5-word shingles (fewer
words: the whole sequence; no words: the empty set, linked with nothing). Documents link at a Jaccard similarity of 0.85
(the threshold of the query; the operator's default is the general 0.8).

1. One pass writes, per document, its set's size and digest and a signature. Both permutations act on 32-bit integers:
   the first is a bijection of the folded shingle hash, the second is applied to that value shifted by k (cyclic in
   2**32), so one pair of permutations yields every coordinate.
2. Documents with equal sets form a class (partial minimum per digest), so copies never meet in pairs.
3. Class representatives meet in bands of ``rows`` coordinates. Small buckets give their pairs, large ones only pairs with
   their least member. Pairs whose sizes or signatures rule the threshold out go; the others are confirmed on the full
   sets, rebuilt from the compressed texts.
4. After the components are known, members of a large bucket that are still apart from its main component are held
   against all its members, block by block. So no link is lost to a bucket's size and copies of one text cost no square.

A pair at the threshold is missed by all bands with probability (1 - 0.85**5)**28 < 1e-7; the signature test leaves at
least five standard deviations. Shingles are compared by 64-bit hashes.

Null text counts as empty; an empty table gives no rows; of ties in a bucket the least id is the pivot. A null doc_id is reported back as null and never becomes another document's component id as
long as its component holds an id. Repeated rows are copies of each other. Extra columns are ignored by ``near_duplicates``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.llm.common import MAX_BROADCAST, NULL_ID, ascii_words, hashed, keyed, lower_ascii, materialize, mix64, released, slices, table
from strideforge.llm.components import connected

ROWS, BANDS = 5, 28
#: Buckets up to this size give all pairs at once; larger ones go by their least member first. No pair is left out.
SMALL_BUCKET = 12
#: Rows of a block in which a large bucket's members are compared.
BLOCK = 256
LAST = 2**63 - 1


def shingle_sets(texts, width=5):
    """For an Arrow string array: flat sorted distinct shingle hashes (uint64) and their offsets by row."""
    import numpy as np
    codes, offsets, vocabulary = ascii_words(lower_ascii(texts))
    word = hashed(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(offsets)
    sets, sizes = [], np.zeros(len(count), np.int64)
    if len(word) >= width:
        h = np.zeros(len(word) - width + 1, np.uint64)
        for j in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - width + 1 + j])
    for i, (a, n) in enumerate(zip(offsets[:-1], count)):
        if n >= width:
            s = np.sort(h[a : a + n - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = np.full(1, n, np.uint64)
            for j in range(a, a + n):
                s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + word[j : j + 1])
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def circulant_signatures(flat, offsets, k):
    """Rows of k uint32 coordinates for the non-empty sets, from two permutations of 32-bit integers."""
    import numpy as np

    folded = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    first = (folded ^ (folded >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first ^= first >> np.uint32(12)
    out = np.empty((len(offsets) - 1, k), np.uint32)
    row = 0
    while row < len(out):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 40_000, "right")) - 1)
        part, starts = first[offsets[row] : offsets[end]], offsets[row:end] - offsets[row]
        x, y = np.empty_like(part), np.empty_like(part)
        for j in range(k):
            np.add(part, np.uint32(j), out=x)  # the cyclic shift
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[row:end, j] = np.minimum.reduceat(x, starts)
        row = end
    return out


def signed(docs, k):
    """Per row of docs(doc_id, text): _id, n_shingles, digest (null: empty set), signature (k little-endian uint32)."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = shingle_sets(part.column("text"))
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                digest, sig = [None] * len(size), [None] * len(size)
                if len(full):
                    rows = circulant_signatures(flat, np.concatenate([offsets[full], offsets[-1:]]), k)
                    for i, r in zip(full, rows):
                        digest[i] = hashlib.md5(flat[offsets[i] : offsets[i + 1]].tobytes()).digest()
                        sig[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(size), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                    ["_id", "n_shingles", "digest", "signature"],
                )

    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), "text").mapInArrow(
        run, "_id long, n_shingles long, digest binary, signature binary"
    )


def banded(classes, rows, bands):
    """Per class (node, n_shingles, signature): an array of one hash per band."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4")
            sig = sig.reshape(batch.num_rows, -1)[:, : rows * bands].reshape(batch.num_rows, bands, rows)
            h = np.tile(np.arange(bands, dtype=np.uint64), (batch.num_rows, 1))
            for j in range(rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j].astype(np.uint64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, h.size + 1, bands, dtype=np.int32)), pa.array(h.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("n_shingles"), lists], ["node", "n_shingles", "bands"]
            )

    return classes.select("node", "n_shingles", "signature").mapInArrow(
        run, "node long, n_shingles long, bands array<long>"
    )


def compressed(docs):
    """_id and the compressed text of every row."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                blobs = [z.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(blobs, pa.binary())], ["_id", "blob"])

    return docs.mapInArrow(run, "_id long, blob binary")


def texts_of(docs, ids):
    """_id and compressed text of the rows with the given ids, and of all rows where the ids are too many to broadcast."""
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), "text")
    if ids.count() <= MAX_BROADCAST:
        docs = docs.join(F.broadcast(ids), "_id", "left_semi")
    return compressed(docs)


def similar(s, t, percent):
    """Whether two sorted sets of hashes reach the similarity."""
    import numpy as np

    common = len(np.intersect1d(s, t, assume_unique=True)) if len(s) and len(t) else 0
    return common > 0 and 100 * common >= percent * (len(s) + len(t) - common)


def confirm(pairs, docs, percent):
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; of ids with several texts, any of them."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        d, memo = zstandard.ZstdDecompressor(), {}

        def sets(ids, blobs):
            """id -> set; the sets of the last batches are kept up to a bound of 4,000,000 hashes."""
            new = {i: b for i, b in zip(ids, blobs) if i not in memo}
            if sum(len(s) for s in memo.values()) > 4_000_000:
                memo.clear()
                released()
                new = dict(zip(ids, blobs))
            keys = list(new)
            for at in range(0, len(keys), 500):
                part = keys[at : at + 500]
                flat, offsets = shingle_sets(pa.array([d.decompress(new[i]).decode() for i in part], pa.string()))
                memo.update({i: flat[offsets[j] : offsets[j + 1]] for j, i in enumerate(part)})

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                blobs_a, blobs_b = batch.column("blob_a").to_pylist(), batch.column("blob_b").to_pylist()
                a = [(i, hash(x)) for i, x in zip(batch.column("a").to_pylist(), blobs_a)]
                b = [(i, hash(x)) for i, x in zip(batch.column("b").to_pylist(), blobs_b)]
                sets(a + b, blobs_a + blobs_b)
                keep = [similar(memo[x], memo[y], percent) for x, y in zip(a, b)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        memo.clear()
        released()

    texts = texts_of(docs, pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())
    left = texts.select(F.col("_id").alias("a"), F.col("blob").alias("blob_a"))
    right = texts.select(F.col("_id").alias("b"), F.col("blob").alias("blob_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "blob_a", "blob_b").mapInArrow(run, "a long, b long")


def close_enough(pairs, nodes, percent):
    """Drop pairs that their signatures put at least five standard deviations below the threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        j = percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            k = x.shape[1]
            keep = (x == y).sum(1) >= k * (j - 5 * (j * (1 - j) / k) ** 0.5)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def apart_links(large, nodes, labels, docs, rows, bands, percent):
    """Links (a, b) between different components that meet in large buckets only.

    Members outside a bucket's main component (that of most members) meet all members of the bucket, in blocks of about
    BLOCK rows. Two blocks are compared at once: pairs of different components whose sizes and signatures allow it, each in
    the first band it shares, are confirmed on their full sets there and then, one link for two components is enough. So
    neither pairs nor their sets leave the block.
    """
    known = nodes.select("node", "n_shingles", "signature").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = large.distinct().join(known, "node")
    sizes = marked.groupBy("key", "label").count()
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("n_main"))
    main = materialize(main, "bucket-mains")  # a plain exchange then, beside which Spark splits the tasks of a large bucket
    marked = materialize(marked.join(main, "key").filter("n_main < size"), "marked")
    texts = texts_of(docs, marked.select(F.col("node").alias("_id")).distinct()).withColumnRenamed("_id", "node")
    deal = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    row = F.struct("node", "n_shingles", "label", "signature", "blob")
    marked = marked.join(texts, "node")
    block = lambda df, *more: df.groupBy("key", "band", deal.alias("deal"), *more).agg(F.collect_list(row).alias("rows"))
    every = block(marked).select("key", "deal", "band", F.col("rows").alias("y"))
    # a block of members apart goes to every block of its bucket by the block's number, so no task holds a whole bucket
    rest = block(marked.filter("label <> main").withColumn("n", F.ceil(F.col("size") / BLOCK)), "n")
    rest = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("deal"), F.col("rows").alias("x"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        z, j, k = zstandard.ZstdDecompressor(), percent / 100, rows * bands
        least = k * (j - 5 * (j * (1 - j) / k) ** 0.5)

        def side(cells):
            v = cells.values
            sig = np.frombuffer(b"".join(v.field("signature").to_pylist()), "<u4").reshape(len(v), -1)
            return [np.asarray(v.field(c)) for c in ("node", "n_shingles", "label")], sig, v.field("blob")

        def sets(blobs, at):
            at = np.unique(at)
            flat, offsets = shingle_sets(pa.array([z.decompress(blobs[int(i)].as_py()).decode() for i in at], pa.string()))
            return {int(i): flat[offsets[n] : offsets[n + 1]] for n, i in enumerate(at)}

        for batch in batches:
            for i in range(batch.num_rows):
                (a, na, la), sa, ta = side(batch.column("x")[i])
                (b, nb, lb), sb, tb = side(batch.column("y")[i])
                same = np.zeros((len(a), len(b)), np.int16)
                for c in range(k):
                    same += sa[:, c][:, None] == sb[:, c][None]
                fits = np.minimum(na[:, None], nb[None]) * 100 >= np.maximum(na[:, None], nb[None]) * percent
                x, y = np.nonzero((same >= least) & fits & (la[:, None] != lb[None]))
                shared = (sa[x] == sb[y])[:, :k].reshape(len(x), bands, rows).all(2).argmax(1)
                keep = shared == batch.column("band")[i].as_py()
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                sx, sy, found = sets(ta, x), sets(tb, y), {}
                for p, q in zip(x.tolist(), y.tolist()):
                    two = (la[p], lb[q])
                    if two not in found and similar(sx[p], sy[q], percent):
                        found[two] = (a[p], b[q])
                del sx, sy
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["a", "b"])
            released()

    return rest.join(every, ["key", "deal"]).select("band", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs, percent=80, rows=ROWS, bands=BANDS):
    """Rows of docs(doc_id, text) with n_shingles, component_id (smallest doc_id reachable) and kept.

    Returns doc_id, n_shingles, component_id, kept: one row per row of docs.
    """
    sets = materialize(signed(docs, rows * bands), "signatures")
    nodes = (
        sets.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    nodes = materialize(nodes, "classes")
    # an id with several texts has a row for each of them, and all of them are one node of the graph
    hashes = banded(nodes, rows, bands)
    # rows: one per class and band; a bucket's least member is its pivot
    spread = hashes.select("node", F.posexplode("bands").alias("band", "key"))
    counts = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    # written first: both sides of the join are then plain exchanges, of which Spark splits the tasks of a large bucket
    members = materialize(spread.join(materialize(counts, "bucket-sizes"), "key"), "buckets")
    small = (
        members.filter(F.col("size") <= SMALL_BUCKET)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("node")).alias("m"))  # at most SMALL_BUCKET nodes
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))
                    )
                )
            ).alias("p")
        )
        .select("p.a", "p.b")
        .filter("a <> b")
    )
    star = members.filter((F.col("size") > SMALL_BUCKET) & (F.col("node") != F.col("pivot")))
    first = small.union(star.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).distinct()
    near = materialize(close_enough(first, nodes, percent).distinct(), "pairs")
    labels = connected(confirm(near, docs, percent))
    large = members.filter(F.col("size") > SMALL_BUCKET).select("node", "band", "key", "size")
    if large.limit(1).count():
        late = materialize(apart_links(large, nodes, labels, docs, rows, bands, percent), "links")
        if late.limit(1).count():  # the components so far are stars already
            labels = connected(late.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    full, empty = sets.filter("digest is not null"), sets.filter("digest is null")
    found = full.select("_id", "n_shingles", "digest").join(nodes.select("digest", "node"), "digest").join(labels, "node", "left")
    found = found.select("_id", "n_shingles", F.coalesce("label", "node").alias("c"))
    found = found.union(empty.select("_id", "n_shingles", F.col("_id").alias("c")))
    as_id = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.select(
        as_id("_id").alias("doc_id"),
        "n_shingles",
        as_id("c").alias("component_id"),
        (F.col("c") == F.col("_id")).alias("kept"),
    )


def one_of_each(docs, percent=80):
    """docs less all but one row of each group of near duplicates: the row of the least doc_id.

    Documents of equal doc_id and different texts are documents of their own, and so are those without an id: they go by a
    number made of their id and text that lies above 2**62 (ids missing: above those), so a document of an ordinary id stays
    before them. Of rows equal in id and text one stays. Texts without words are in no group and all stay, but for such repeated rows.
    """
    rows = keyed(docs)
    seen = rows.groupBy("_id", "_th").agg(F.count("*").alias("n"))
    twice = seen.groupBy("_id").agg(F.count("*").alias("texts"), F.max("n").alias("n"))
    twice = materialize(twice.filter((F.col("texts") > 1) | (F.col("n") > 1) | (F.col("_id") == NULL_ID)), "repeated-ids")
    repeated = twice.count()
    other = [F.col(f"`{c}`").alias(f"_in_{k}") for k, c in enumerate(docs.columns)]
    t = F.coalesce("text", F.lit(""))
    work = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64(t).alias("_th"), *other)
    if repeated:
        ids = twice.select("_id", (F.col("texts") > 1).alias("_again"))
        work = work.join(F.broadcast(ids) if repeated <= MAX_BROADCAST else ids, "_id", "left")
        own = F.shiftrightunsigned(F.xxhash64("_id", "_th"), 3)
        lone = F.when(F.col("_id") == NULL_ID, own + (3 << 61)).when(F.col("_again"), own + (1 << 62))
        work = work.withColumn("_id", F.coalesce(lone, "_id"))
    text = f"_in_{docs.columns.index('text')}"
    found = near_duplicates(work.select(F.col("_id").alias("doc_id"), F.col(text).alias("text")), percent)
    gone = materialize(found.filter("not kept").select(F.col("doc_id").alias("_id")).distinct(), "duplicates")
    few = gone.count() <= MAX_BROADCAST
    kept = work.join(F.broadcast(gone) if few else gone, "_id", "left_anti")
    if repeated:
        once = kept.filter("_again is null")
        kept = once.unionByName(kept.filter("_again is not null").dropDuplicates(["_id"]))
    return kept.select(*[F.col(f"_in_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op5_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op5_minhash": op5_minhash}
ORACLE_SQL = {}
