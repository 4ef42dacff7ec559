"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A word gives two tokens: itself and its shape (runs of capitals, letters, digits and marks, and whether it repeats the
word before it). Features are unigrams and bigrams of both, hashed into ``2**bits`` weights; a feature's value is its share
of the text's words. A score is the logistic of the sparse dot product, so it lies in (0, 1); an empty text scores the
bias alone. Labels, language, source and doc_id never enter a score.

Training takes at most ``max_rows`` labelled rows (those with the smallest hash of doc_id among the rows that are not held
out; the bound keeps the model fit apart from the corpus size) and passes over them ``epochs`` times with per-coordinate
FTRL-proximal updates. Scoring covers every row, every word and every letter, so a text of any length counts whole. Null text
counts as empty. Null labels are not learnt from; of a doc_id with several labels the largest counts. Without any labelled row
(or with empty tables) every score is 0.5. Repeated rows and ties get equal scores. An empty table of documents gives no rows.
A null doc_id is held out. Other columns pass through ``score``, but for one of the result's name (score), which is replaced.
"""

from pyspark.sql import functions as F

from strideforge.llm.common import ascii_words, least_hashes, mix64, slices, table

BITS, MAX_ROWS, EPOCHS = 18, 8000, 3
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.02, 0.5
FOLDS, THRESHOLD = 5, 0.3


def held_out(doc_id):
    """Whether crc32 of the id's text leaves no remainder by the number of folds (null id: it does)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def _shape(word):
    """A word's shape: its classes of characters, each run once."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(texts, bits):
    """For an Arrow string array: feature numbers of all words (4 a word), and offsets by row."""
    import numpy as np
    import xxhash

    codes, offsets, vocabulary = ascii_words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), offsets * 0
    words = vocabulary.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    by_shape = {}
    own = np.fromiter((digest(w, 1) for w in words), np.uint64, len(words))
    shape = np.fromiter((by_shape.get(s) or by_shape.setdefault(s, digest(s, 2)) for s in map(_shape, words)), np.uint64, len(words))
    own, shape = own[codes], shape[codes]
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    before = np.concatenate([[0], codes[:-1]])
    repeats = ((codes == before) & ~first).astype(np.uint64)
    shape = mix64(shape + repeats)
    k = np.uint64(0x9E3779B97F4A7C15)
    pairs = []
    for x in (own, shape):
        y = np.concatenate([x[:1], x[:-1]])
        y[first] = 0
        pairs += [mix64(x), mix64(y * k + x + np.uint64(7))]
    f = np.stack(pairs, 1) >> np.uint64(64 - bits)
    return f.astype(np.int64).reshape(-1), offsets * 4


def fit(y, f, v, offsets, bits=BITS, epochs=EPOCHS):
    """Weights, bias last, from labels y and rows f[a:b] (features) and v[a:b] (values) between neighbouring offsets."""
    import numpy as np

    n = (1 << bits) + 1
    z, s, w = np.zeros(n), np.zeros(n), np.zeros(n)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            a, b = offsets[i], offsets[i + 1]
            k, x = np.append(f[a:b], n - 1), np.append(v[a:b], 1.0)
            p = 1 / (1 + np.exp(-np.clip(w[k] @ x, -30, 30)))
            g = (p - y[i]) * x
            sigma = (np.sqrt(s[k] + g * g) - np.sqrt(s[k])) / ALPHA
            z[k] += g - sigma * w[k]
            s[k] += g * g
            zk = z[k]
            w[k] = np.where(np.abs(zk) <= L1, 0, (np.sign(zk) * L1 - zk) / ((BETA + np.sqrt(s[k])) / ALPHA + L2))
    return w.astype(np.float32)


#: Text bytes that a task turns into features at a time; a worker that waits for its next task keeps little memory then.
SLICE = 1 << 20

#: The value of a feature is its share of the words times this scale.
SCALE = 4.0


def _counted(bits):
    """mapInArrow over (label, text): label and the features of each text with their values."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                f, offsets = features(part.column("text"), bits)
                fs, vs = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    u, c = np.unique(f[a:b], return_counts=True)
                    fs.append(u.astype(np.int32))
                    vs.append((c * (4 * SCALE / max(1, b - a))).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(fs, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float32()))], ["label", "f", "v"]
                )

    return run


def _fitted(bits, epochs):
    """mapInArrow over all (label, f, v) of the bounded sample in one task: one row with the weights, none without rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("label", pa.float64())]))])
        if not rows.num_rows:
            return
        f, v = (rows.column(c).combine_chunks() for c in ("f", "v"))
        y, offsets = np.asarray(rows.column("label").combine_chunks()), np.asarray(f.offsets).astype(np.int64)
        sums = np.diff(np.concatenate([[0], np.cumsum(np.asarray(f.values), dtype=np.int64)])[offsets])
        order = np.lexsort((y, sums, np.diff(offsets)))  # an order that does not depend on the tasks before
        size = np.diff(offsets)[order]
        at = np.repeat(offsets[:-1][order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        w = fit(y[order], np.asarray(f.values)[at], np.asarray(v.values)[at], np.concatenate([[0], np.cumsum(size)]), bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])

    return run


def train(docs, labels, label="quality", bits=BITS, max_rows=MAX_ROWS, epochs=EPOCHS):
    """Weights learnt from docs(doc_id, text) and labels(doc_id, label), or None without labelled rows.

    The features of the at most max_rows texts meet in one task, which returns the weights; the driver sees nothing else.
    """
    import numpy as np

    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    chosen = least_hashes(chosen, "_h", max_rows).drop("_h")
    # at most max_rows rows of two numbers: safe to broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    counted = texts.select("label", "text").mapInArrow(_counted(bits), "label double, f array<int>, v array<float>")
    found = counted.repartition(1).mapInArrow(_fitted(bits, epochs), "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else None


def score(docs, weights, bits=BITS, name="score"):
    """docs with a column ``name``: probability of label 1 by the weights (at most ``2**bits + 1`` numbers, broadcast)."""
    names = [c for c in docs.columns if c != name]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    if weights is None:
        return kept.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                f, offsets = features(part.column("text"), bits)
                sums = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])
                n = np.diff(offsets)
                x = (sums[offsets[1:]] - sums[offsets[:-1]]) * 4 * SCALE / np.maximum(n, 1) + w[-1]
                p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p)], [*names, name])

    return kept.mapInArrow(run, kept.limit(0).schema.add(name, "double"))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL = {}
