"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Encoding: Spark's regular expressions cut each text into pre-tokens. Runs of documents form blocks of bounded size; a block
keeps its pre-tokens by position as codes into its own distinct words, and sends those words, packed by hash, into the
shuffle. There every distinct word of the whole corpus meets in one bucket and is encoded once, by merging the pair of
lowest rank; its ids go back to the blocks, which replace code by ids in the order of the positions. A frequent word costs
one entry per block, so no word is hot. Decoding looks every id up in the token-byte table (a broadcast whose size is
checked) and joins the bytes in order.

Null text counts as empty: no ids, and the empty string's bytes. Repeated rows and null ids are encoded like all others;
rows are never matched by their id. Other columns pass through ``encode`` unchanged. Token files are a parameter; nothing
is trained and nothing of a file is kept.
"""

import base64

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideforge.llm.common import fresh, materialize, released, table

#: A table of token bytes larger than this is refused, as it is broadcast.
MAX_TABLE_BYTES = 64 << 20
#: Text bytes of a block, about.
BLOCK_BYTES = 20 << 20
#: Distinct words that a task remembers at most; beyond it forgets and encodes again.
MEMO = 1_000_000
#: Least numbers that take two bytes and five bytes in a packed array.
TWO, FIVE = 192, 192 + 63 * 256
BLOCKS = "block long, bucket int, words binary, codes binary, counts binary, n_words array<int>, rows binary"


def load_ranks(path):
    """Token bytes in order of their ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    if sum(map(len, tokens)) > MAX_TABLE_BYTES:
        raise ValueError("the token table is too large to broadcast")
    return tokens


def merge_pairs(word, ranks):
    """Ids of one word: again and again joins the leftmost pair of lowest rank."""
    import heapq

    if word in ranks:
        return [ranks[word]]
    n = len(word)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != to:
            continue  # one of its parts has been joined since
        alive[j], end[i], right[i] = False, to, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        k = left[i]
        if k >= 0 and (r := ranks.get(word[k:to])) is not None:
            heapq.heappush(heap, (r, k, to))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def pack(numbers):
    """Non-negative integers, small ones mostly, as compressed byte planes: first bytes, then the further bytes of larger ones."""
    import numpy as np
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    two, five = (numbers >= TWO) & (numbers < FIVE), numbers >= FIVE
    lead = np.where(numbers < TWO, numbers, 255).astype(np.uint8)
    x = numbers[two] - TWO
    lead[two] = TWO + (x >> 8)
    rest = (numbers[five] - FIVE).astype("<u4").view(np.uint8).reshape(-1, 4).T
    parts = [z.compress(b) for b in (lead.tobytes(), (x & 255).astype(np.uint8).tobytes(), np.ascontiguousarray(rest).tobytes())]
    return b"".join(len(b).to_bytes(4, "little") + b for b in parts)


def unpack(packed):
    import numpy as np
    import zstandard

    d, at, parts = zstandard.ZstdDecompressor(), 0, []
    while at < len(packed):
        n = int.from_bytes(packed[at : at + 4], "little")
        parts.append(np.frombuffer(d.decompress(packed[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    out = parts[0].astype(np.int64)
    two, five = (parts[0] >= TWO) & (parts[0] < 255), parts[0] == 255
    out[two] = TWO + ((out[two] - TWO) << 8) + parts[1]
    out[five] = FIVE + np.ascontiguousarray(parts[2].reshape(4, -1).T).view("<u4").reshape(-1)
    return out


def by_frequency(counts):
    """Places of distinct words from the most frequent on, ties in order of place."""
    import numpy as np

    return np.argsort(-counts, kind="stable")


def _blocks(words, names, n_buckets):
    """Rows (words, rest...) to block rows: one with codes, row sizes and the other columns, and one per bucket of words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash
        import zstandard
        from pyspark import TaskContext

        z = zstandard.ZstdCompressor(level=3)
        block = TaskContext.get().partitionId() << 32

        def packed(part):
            lists = part.column("_words")
            flat = lists.flatten().cast(pa.large_binary())
            coded = flat.dictionary_encode()
            vocabulary = coded.dictionary
            vocabulary = vocabulary.take(order := pc.sort_indices(vocabulary))
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in vocabulary.to_pylist()), np.int32, len(vocabulary))
            dealt = np.argsort(bucket, kind="stable")
            place = np.empty(len(dealt), np.int64)
            place[np.asarray(order)[dealt]] = np.arange(len(dealt))
            codes = place[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64)
            # the most frequent words get the smallest numbers; their counts tell the order again
            counts = np.bincount(codes, minlength=len(dealt))
            rank = np.empty(len(dealt), np.int64)
            rank[by_frequency(counts)] = np.arange(len(dealt))
            codes, counts = pack(rank[codes]), pack(counts)
            rest = part.select(names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            n_words = np.asarray(pc.list_value_length(lists)).astype(np.int32)
            rows = [(block, -1, None, codes, counts, n_words.tolist(), z.compress(sink.getvalue()))]
            vocabulary = vocabulary.take(pa.array(dealt))
            lengths = np.asarray(pc.binary_length(vocabulary)).astype("<u4")
            starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            data = b"".join(vocabulary.to_pylist())
            ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
            a = 0
            for k, b in enumerate(ends):
                if b > a:
                    blob = np.uint32(b - a).tobytes() + lengths[a:b].tobytes() + data[starts[a] : starts[b]]
                    rows.append((block, k, z.compress(blob), None, None, None, None))
                a = b
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()))],
                ["block", "bucket", "words", "codes", "counts", "n_words", "rows"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(pc.fill_null(batch.column("_bytes"), 0)).astype(np.int64) + 16
            piece = (np.cumsum(size) - size) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield packed(batch.slice(int(a), int(b - a)))
                released()
                block += 1

    return words.mapInArrow(run, BLOCKS)


def _encode_words(rows, tokens):
    """Rows (block, bucket, words), sorted by bucket: each distinct word is encoded once; gives (block, bucket, ids)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        ranks = {t: i for i, t in enumerate(tokens.value)}
        d = zstandard.ZstdDecompressor()
        memo, at = {}, None
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != at or len(memo) > MEMO:
                    memo, at = {}, bucket
                blob = d.decompress(blob)
                n = int(np.frombuffer(blob, "<u4", 1)[0])
                ends = (np.cumsum(np.frombuffer(blob, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
                a, ids, counts = 4 + 4 * n, [], []
                for b in ends:
                    w = blob[a:b]
                    a = b
                    got = memo.get(w)
                    if got is None:
                        got = memo[w] = merge_pairs(w, ranks)
                    ids += got
                    counts.append(len(got))
                out.append(n.to_bytes(4, "little") + pack(np.array(counts + ids, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"])
        del memo, ranks
        released()

    return rows.mapInArrow(run, "block long, bucket int, ids binary")


def expand(values, starts, counts):
    """Concatenates values[s : s + n] for all (s, n)."""
    import numpy as np

    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return values[shift + np.arange(total, dtype=np.int64)]


def encode(docs, path, pattern, text="text", buckets=None, keep=None, then=None):
    """docs, or its columns ``keep``, with a column ids (array of int): the BPE ids of every whole text.

    then: from the result's schema to a step over its Arrow batches and the step's schema; the same workers do it.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(load_ranks(path))
    n_buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = docs.columns if keep is None else keep
    if "ids" in names:
        raise ValueError("a column named ids is in the way")
    inner = {c: fresh(docs, f"{c}_") for c in names if c in ("_words", "_bytes")}
    if inner:  # names that are used inside
        if then is not None:
            raise ValueError("a column named _words or _bytes is in the way")
        found = encode(docs.withColumnsRenamed(inner), path, pattern, inner.get(text, text), buckets, [inner.get(c, c) for c in names])
        return found.withColumnsRenamed({v: k for k, v in inner.items()})
    out_schema = docs.select(names).schema.add("ids", T.ArrayType(T.IntegerType()))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cut = F.regexp_extract_all(t, F.lit("(?U)" + pattern), F.lit(0))
    words = docs.select(*[F.col(f"`{c}`") for c in names], cut.alias("_words"), F.octet_length(t).alias("_bytes"))
    blocks = materialize(_blocks(words, names, n_buckets), "bpe-blocks", 10_000)  # larger blocks send fewer distinct words
    sent = blocks.filter("bucket >= 0").select("block", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")
    ids = _encode_words(sent, tokens).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("ids"))
    whole = blocks.filter("bucket = -1").select("block", "codes", "counts", "n_words", "rows").join(ids, "block", "left")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                parts = batch.column("ids")[r].as_py() or []
                counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for p in parts:
                    n, x = int.from_bytes(p["ids"][:4], "little"), unpack(p["ids"][4:])
                    counts.append(x[:n])
                    flat.append(x[n:].astype(np.int32))
                counts, flat = np.concatenate(counts), np.concatenate(flat)
                starts = np.cumsum(counts) - counts
                order = by_frequency(unpack(batch.column("counts")[r].as_py())).astype(np.int32)
                codes = order[unpack(batch.column("codes")[r].as_py())]
                n_words = np.asarray(batch.column("n_words")[r].values)
                rest = pa.ipc.open_stream(d.decompress(batch.column("rows")[r].as_py())).read_all().combine_chunks()
                word_ends = np.cumsum(n_words, dtype=np.int64)
                a = row = 0
                while row < len(n_words):  # about a million words at a time
                    end = max(row + 1, int(np.searchsorted(word_ends, a + 1_000_000, "right")))
                    b = int(word_ends[end - 1])
                    c = codes[a:b]
                    n_ids = np.concatenate([[0], np.cumsum(counts[c])])
                    offsets = n_ids[np.concatenate([[a], word_ends[row:end]]) - a]
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(expand(flat, starts[c], counts[c])))
                    some = rest.slice(row, end - row)
                    yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in some.columns), lists], [*rest.schema.names, "ids"])
                    a, row = b, end
                del parts, counts, flat, starts, order, codes, rest
                released()

    step, schema = run, out_schema
    if then is not None:
        after, schema = then(out_schema)
        step = lambda batches: after(run(batches))
    return whole.select("codes", "counts", "n_words", "rows", "ids").mapInArrow(step, schema)


def token_table(tokens):
    """Bytes of all tokens in a row, and where each starts and how long it is."""
    import numpy as np

    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoding(spark, path, digests, keep_ids):
    """From the schema of rows(..., ids) to the step over their Arrow batches that decodes, and its schema: see ``decode``."""
    tokens = spark.sparkContext.broadcast(load_ranks(path))
    new = ("n_tokens long", "ids_sha256 string", "decoded_sha256 string") if digests else ("decoded binary",)

    def of(given):
        names = [c for c in given.fieldNames() if (keep_ids or c != "ids") and c not in {x.split()[0] for x in new}]
        schema = T.StructType([given[c] for c in names])
        for c in new:
            schema = schema.add(*c.split())

        def run(batches):
            import hashlib

            import numpy as np
            import pyarrow as pa

            data, starts, sizes = token_table(tokens.value)
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    batch = whole.slice(at, 200)
                    out = []
                    for x in batch.column("ids"):
                        ids = np.asarray(x.values).astype(np.int64) if x.is_valid else np.zeros(0, np.int64)
                        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
                            raise ValueError("an id is not in the token table")
                        decoded = expand(data, starts[ids], sizes[ids]).tobytes()
                        if digests:
                            out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                        else:
                            out.append((decoded,))
                    types = (pa.int64(), pa.string(), pa.string()) if digests else (pa.binary(),)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(n) for n in names), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                        [*names, *schema.names[len(names) :]],
                    )

        return run, schema

    return of


def decode(rows, path, digests=False, keep_ids=False):
    """rows(..., ids) with the decoded bytes for ids, or with n_tokens, ids_sha256 and decoded_sha256 where digests are asked for.

    An unknown id is an error; null ids count as none. keep_ids: ids stay as a column. A column of rows that has the name of a new
    one gives way to it.
    """
    return rows.mapInArrow(*_decoding(rows.sparkSession, path, digests, keep_ids)(rows.schema))


def round_trip(docs, path=None, pattern=None, keep_ids=False):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, where asked for) of docs(doc_id, text).

    The worker that joins the ids of a block decodes them as well: a task of that stage has one worker and the ids pass through no
    other batch.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    return encode(docs, path, pattern, keep=["doc_id"], then=_decoding(docs.sparkSession, path, True, keep_ids))


def op3_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL = {}
