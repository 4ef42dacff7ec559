"""Approximate nearest neighbours: inverted lists of coarse centroids with product-quantised residuals, then exact reranking.

Fit: there are about as many lists as the root of the number of vectors, at most ``max_train / 16``. A sample (the vectors with
the smallest hash of vec_id: 32 for each list, 8,192 at least, ``max_train`` at most; a documented bound) gives the coarse centroids and,
from its residuals, a codebook of 256 entries for each of ``parts`` slices, by k-means, in one task.
Index: every row gets its list, its code and the length of what the code leaves out. Rows of a list are dealt at random into blocks of about
``block_rows`` rows, so a list that holds a third of all rows is many blocks and never one task.
Search: each query visits its ``probes`` nearest lists. Their number comes from the fit: the sample's own neighbours, searched in
full for ``TRIED`` of its vectors, lie in lists of certain places in the order of distance from the query, and so many lists are
visited as hold the share ``found`` of them, a list more than that where lists are few. The sample is sparser than the table, so its neighbours lie farther off and the number errs
to the safe side. Queries in clusters visit few lists, those in high-dimensional noise, which has no near lists, many.
Queries of a list go to each of its blocks. Distances to codes come from a table per query and list (asymmetric distances).
The distance of a code and what the code leaves out bound a row's true distance from both sides; all rows whose lower bound
does not exceed the k-th smallest upper bound are measured exactly, on the original vectors in double precision, there and
then. So no neighbour in a visited list is lost, however many rows share a code or lie next to each other, and a block gives k rows
per query. Of these the k nearest stay, ties to the smaller vec_id.

A vector that is null, zero, of another length than most, or holds a null or non-finite component takes no part, neither as
query nor as candidate. A query's own row (any row with its vec_id) is no candidate; rows with equal vec_id are candidates
of others each by itself, and as a query the one with the least components counts. Null ids take no part. Fewer candidates than k give fewer
rows. An empty table gives no rows. Other columns are ignored.
"""

import pickle

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.llm.common import least_hashes, materialize, table

MAX_TRAIN, LEAST_TRAIN, PARTS, BLOCK_ROWS, GROUP_ROWS, LOT = 65_536, 8_192, 16, 4096, 256, 8
#: Share of the sample's neighbours that the visited lists hold, vectors tried for it, and their neighbours looked at.
FOUND, TRIED, NEIGHBOURS = 0.98, 500, 10


def kmeans(x, k, rounds=12, seed=0):
    """Centroids of the rows of x; empty ones take rows far from their own.

    The first ones are drawn with a probability by the squared distance to those before, so a group of near copies, however
    large, does not take more than its share of space.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    picked = [int(rng.integers(len(x)))]
    gap = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and gap.max() > 0:
        picked.append(int(np.searchsorted(np.cumsum(gap), rng.random() * gap.sum())))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
    k = len(picked)
    c = x[picked].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(a, x[:, d], k) / np.maximum(n, 1), c[:, d])
        if (n == 0).any():
            far = np.argsort(-((x - c[a]) ** 2).sum(1))[: (n == 0).sum()]
            c[n == 0] = x[far]
    return c


def nearest(x, c):
    import numpy as np

    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = ((c**2).sum(1)[None] - 2 * x[i : i + 4096] @ c.T).argmin(1)
    return out


def bounds(dim, parts):
    import numpy as np

    return np.linspace(0, dim, min(parts, dim) + 1).astype(int)


def usable(vectors, dim=None):
    """vec_id and embedding of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    if dim is None:
        sizes = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = sizes["n"] if sizes else 0
    return v.filter(F.size("embedding") == dim), dim


def probes_for(x, own, coarse, found=FOUND):
    """The number of nearest lists that hold the share ``found`` of the neighbours of some rows of x among all of them."""
    import numpy as np

    tried = np.random.default_rng(7).permutation(len(x))[:TRIED]
    norms, places = (x**2).sum(1), []
    for i in range(0, len(tried), 50):
        q = x[tried[i : i + 50]]
        far = norms[None] - 2 * q @ x.T
        far[np.arange(len(q)), tried[i : i + 50]] = np.inf
        near = np.argpartition(far, min(NEIGHBOURS, len(x) - 1) - 1, axis=1)[:, :NEIGHBOURS] if len(x) > 1 else np.zeros((len(q), 0), int)
        to = (coarse**2).sum(1)[None] - 2 * q @ coarse.T
        rank = np.argsort(np.argsort(to, axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(rank, own[near], 1).ravel())
    places = np.sort(np.concatenate(places))
    return min(len(coarse), int(places[int(np.ceil(found * len(places))) - 1]) + 2) if len(places) else 1


def fit(vectors, lists=None, parts=PARTS, max_train=MAX_TRAIN, found=FOUND):
    """Coarse centroids, codebooks and the number of lists to visit from a bounded sample, or None without vectors.

    lists: their number, about the root by default.
    """
    total = vectors.count()
    lists = min(lists or max(1, int(total**0.5)), max_train // 16)
    sample = least_hashes(vectors.withColumn("_h", F.xxhash64("vec_id")), "_h", min(max_train, max(LEAST_TRAIN, 32 * lists)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        some = [_matrix(b.column("embedding")) for b in batches if b.num_rows]
        if not some:
            return
        x = np.concatenate(some)
        x = x[np.lexsort(x.T)]  # an order that does not depend on the tasks before
        coarse = kmeans(x, max(1, min(lists, len(x) // 8)))
        own = nearest(x, coarse)
        residual = x - coarse[own]
        at = bounds(x.shape[1], parts)
        books = [kmeans(residual[:, a:b], 256, seed=i + 1) for i, (a, b) in enumerate(zip(at, at[1:]))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((coarse, books, probes_for(x, own, coarse, found)))], pa.binary())], ["model"])

    found = sample.select("embedding").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def _matrix(column):
    import numpy as np

    return np.asarray(column.flatten()).reshape(len(column), -1)


def coded(vectors, model):
    """Every vector with its list, its code, the length that the code leaves out, and a random number to deal it by."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        coarse, books, _ = model.value
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            own = nearest(x, coarse)
            r, at = x - coarse[own], bounds(x.shape[1], len(books))
            code = np.stack([nearest(r[:, a:b], c) for c, a, b in zip(books, at, at[1:])], 1)
            kept = np.concatenate([c[code[:, m]] for m, c in enumerate(books)], 1)
            left = np.sqrt(((r - kept) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(left), pa.array(rng.integers(0, 2**31 - 1, len(x)).astype(np.int32))],
                ["vec_id", "embedding", "list", "code", "left", "lot"],
            )

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, list int, code binary, left double, lot int")


def visits(queries, model, probes=None):
    """query_id, embedding, list: a row for each list that a query visits. probes: their number instead of the fitted one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coarse, _, fitted = model.value
        n = min(max(1, probes or fitted), len(coarse))
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                x = _matrix(batch.column("embedding"))
                far = (coarse**2).sum(1)[None] - 2 * x @ coarse.T
                near = np.argsort(far, axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("embedding").take(rows), pa.array(near.ravel().astype(np.int32))], ["query_id", "embedding", "list"])

    return queries.mapInArrow(run, "query_id long, embedding array<double>, list int")


def dealt(rows, size, by):
    """rows with the number of their block (deal) and the number of blocks of their list (deals), of about ``size`` rows each."""
    counts = rows.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("deals"))
    return rows.join(F.broadcast(counts), "list").withColumn("deal", F.pmod(by, F.col("deals")))  # counts: one row a list


def scanned(groups, blocks, model, k):
    """query_id, vec_id, score: the k nearest rows of each block for each query of a group that visits its list."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coarse, books, _ = model.value
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("list")[i].as_py()
                rows, asked = batch.column("rows")[i].values, batch.column("queries")[i].values
                ids, x, left = np.asarray(rows.field("vec_id")), _matrix(rows.field("embedding")), np.asarray(rows.field("left"))
                codes = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(len(ids), -1).T
                q_ids, q = np.asarray(asked.field("query_id")), _matrix(asked.field("embedding"))
                at = bounds(q.shape[1], len(books))
                out = []
                for query, v in zip(q_ids, q):
                    r, d = v - coarse[own], np.zeros(len(ids))
                    for m, (c, a, b) in enumerate(zip(books, at, at[1:])):
                        d += ((r[a:b] - c) ** 2).sum(1)[codes[m]]
                    d = np.sqrt(d)
                    some = np.flatnonzero(ids != query)
                    if len(some) > k:
                        cut = np.partition((d + left)[some], k - 1)[k - 1]
                        some = some[(d - left)[some] <= cut * (1 + 1e-9) + 1e-12]
                    score = np.sqrt(((x[some] - v) ** 2).sum(1))
                    best = np.lexsort((ids[some], score))[:k]
                    out.append((np.full(len(best), query), ids[some][best], score[best]))
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    joined = blocks.join(groups, ["list", "deal", "lot"]).select("list", "rows", "queries")
    return joined.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors, is_query, k=10, lists=None, parts=PARTS, probes=None, max_train=MAX_TRAIN, found=FOUND):
    """query_id, rank, vec_id, score: the k nearest found for the rows of vectors(vec_id, embedding) where is_query holds."""
    spark = vectors.sparkSession
    vectors, _ = usable(vectors)
    fitted = fit(vectors, lists, parts, max_train, found)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(fitted)
    codes = dealt(materialize(coded(vectors, model), "ivf-codes"), BLOCK_ROWS, F.col("lot"))
    blocks = codes.groupBy("list", "deal").agg(F.collect_list(F.struct("vec_id", "code", "left", "embedding")).alias("rows"))  # about BLOCK_ROWS
    asked = vectors.filter(is_query).groupBy(F.col("vec_id")).agg(F.min("embedding").alias("embedding"))
    some = dealt(visits(asked, model, probes), GROUP_ROWS, F.xxhash64("query_id"))
    groups = some.groupBy("list", "deal").agg(F.collect_list(F.struct("query_id", "embedding")).alias("queries"))  # about GROUP_ROWS
    # each group of queries goes to each block of its list; LOT groups and a block meet in one row, so neither a list of many
    # rows nor one that many queries visit is the work of one task
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    n_blocks, n_groups = (rows.select("list", "deals").distinct() for rows in (codes, some))  # one row a list
    groups = groups.withColumn("lot", F.floor(F.col("deal") / LOT)).drop("deal").join(F.broadcast(n_blocks), "list").withColumn("deal", upto(F.col("deals")))
    blocks = blocks.join(F.broadcast(n_groups), "list").withColumn("lot", upto(F.ceil(F.col("deals") / LOT)))
    near = scanned(groups.select("list", "deal", "lot", "queries"), blocks.select("list", "deal", "lot", "rows"), model, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ivfpq(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


QUERIES = {"op9_ivfpq": op9_ivfpq}
ORACLE_SQL = {}
