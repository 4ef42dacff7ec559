"""Splits as assignment tables (fold, row_id, side), never index arrays."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.schemas import REPEATS, SEED, TRAIN_FRACTION

GROUP = ["label", "session"]


def _placed(rows, order, extra=()):
    w = Window.partitionBy(*extra, *GROUP)
    return rows.withColumns({"_place": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})


def _cut(placed, fraction, guard):
    train = F.bround(F.col("_n") * fraction).cast("int")
    side = F.when(F.col("_place") > train, "test").when(F.col("_place") <= train - guard, "train")
    return placed.withColumn("side", side).filter("side is not null")


def time_blocked(rows, fraction=TRAIN_FRACTION, guard=0):
    """First share of each (label, session) by start is train, less the last guard rows; halves round to even."""
    return _cut(_placed(rows, ["start"]), fraction, guard).select(F.lit(0).alias("fold"), "row_id", "side")


def random_split(rows, fraction=TRAIN_FRACTION, repeats=REPEATS, seed=SEED):
    """Sizes of time_blocked, rows in the order of a seeded hash, for each repeat."""
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = [F.md5(F.concat_ws("_", "row_id", F.lit(seed), "fold")), "row_id"]
    return _cut(_placed(each, order, ["fold"]), fraction, 0).select("fold", "row_id", "side")


def _sides(tested, k):
    folds = tested.withColumn("fold", F.explode(F.sequence(F.lit(0), k - 1)))
    return folds.select("fold", "row_id", F.when(F.col("fold") == F.col("_fold"), "test").otherwise("train").alias("side"))


def block_of(rows, k=5, extra=()):
    """rows with fold: the number of its contiguous block by start within (label, session); the first n mod k are one larger."""
    return rows.withColumn("fold", F.ntile(k).over(Window.partitionBy(*extra, *GROUP).orderBy("start")) - 1)


def contiguous_blocks(rows, k=5):
    """The blocks of ``block_of`` as k folds of an assignment table; evaluation takes ``block_of``, which repeats no row."""
    return _sides(block_of(rows, k).withColumnRenamed("fold", "_fold"), F.lit(k))


def held_session(rows):
    """rows with fold: that of ``leave_one_session_out`` which tests the row's session, null for sessions beyond the last fold."""
    sessions = rows.select(*GROUP).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("session")) - 1)
    k = sessions.groupBy("label").count().agg(F.min("count").alias("k"))
    held = sessions.join(F.broadcast(k), F.col("_rank") < F.col("k"))  # k: one row
    return rows.join(held.groupBy("session").agg(F.min("_rank").alias("fold")), "session", "left")


def leave_one_session_out(rows):
    """Fold k holds out the k-th session (sorted) of every class; folds up to the least number of sessions of a class."""
    sessions = rows.select(*GROUP).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("session")) - 1)
    k = sessions.groupBy("label").count().agg(F.min("count").alias("k"))
    held = sessions.join(F.broadcast(k), F.col("_rank") < F.col("k")).select("session", F.col("_rank").alias("_fold"))
    folds = rows.join(F.broadcast(k)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    out = folds.join(held.distinct().withColumnsRenamed({"session": "_s", "_fold": "_f"}), (F.col("session") == F.col("_s")) & (F.col("fold") == F.col("_f")), "left")
    return out.select(F.col("fold").cast("int").alias("fold"), "row_id", F.when(F.col("_s").isNotNull(), "test").otherwise("train").alias("side"))


def fixed_session(rows, index=0):
    """The index-th session (sorted) of every class is test, the rest train."""
    rank = F.dense_rank().over(Window.partitionBy("label").orderBy("session")) - 1
    held = rows.withColumn("_r", rank).filter(F.col("_r") == index).select("session").distinct()
    test = rows.join(held, "session", "left_semi").select(F.lit(0).alias("fold"), "row_id", F.lit("test").alias("side"))
    train = rows.join(held, "session", "left_anti").select(F.lit(0).alias("fold"), "row_id", F.lit("train").alias("side"))
    return test.unionByName(train)


def disjoint(rows, assignment, key="session"):
    """Keys that stand on both sides of a fold (none in a sound split)."""
    both = assignment.join(rows, "row_id").select("fold", key, "side")
    train = both.filter("side = 'train'").select("fold", key)
    return train.intersect(both.filter("side = 'test'").select("fold", key))


def coverage(rows, assignment):
    """rows' ids with n_tested, the number of folds that test them, and n_both, those that have them on both sides (0 in a sound split)."""
    sides = assignment.groupBy("row_id", "fold").agg(F.max((F.col("side") == "test").cast("long")).alias("t"), F.max((F.col("side") == "train").cast("long")).alias("r"))
    n = sides.groupBy("row_id").agg(F.sum("t").alias("n_tested"), F.sum(F.col("t") * F.col("r")).alias("n_both"))
    return rows.select("row_id").join(n, "row_id", "left").fillna(0, ["n_tested", "n_both"])


def sessions_per_class(rows):
    return rows.groupBy("label").agg(F.countDistinct("session").alias("n_sessions"))


def session_purity(rows):
    """Share of a session's most common label."""
    n = rows.groupBy("session", "label").count()
    return n.groupBy("session").agg((F.max("count") / F.sum("count")).alias("purity"))
