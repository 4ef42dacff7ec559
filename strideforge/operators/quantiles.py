"""Exact percentiles of groups of any size: selection by histograms over the bits of the values, refined in a fixed number of passes.

A double's bits, read as a whole number and turned round for negative ones, have the order of the doubles. Each pass counts, by
partial aggregates, the rows of each group by the next 16 bits behind the bits already known of the wanted ranks; running
sums over at most 65,536 counts a rank tell the next bits and the rank behind them. After four passes all bits are known. No task
holds the values of a group, and what is written between passes is a row for each group and rank.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.operators.store import written

BITS = 16


def ordered_bits(value):
    """A long with the order of a double column; both zeros are one, NaN comes last."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + 0.0).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def from_bits(bits):
    """The double of ``ordered_bits``."""
    raw = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


#: Values of a group that a task may hold: the groups beyond it are refined.
SMALL = 100_000


def exact_percentiles(rows, by, value, shares, small=SMALL):
    """by and a column for each of shares (name -> 0..1): interpolated percentiles of the values that are not null, per group.

    They equal ``percentile``; groups without values are left out. Groups of at most small values are taken by ``percentile`` itself,
    whose counts of them a task can hold; the passes are over the rows of larger groups alone, and none where there is no such group.
    """
    by = list(by)
    told = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    n = written(told.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    large = n.filter(F.col("_n") > small)
    n_large = large.count()
    name_of = {c: f"_k{i}" for i, c in enumerate(by)}
    keys = lambda t: F.broadcast(t.select(*[F.col(c).alias(k) for c, k in name_of.items()]))  # noqa: E731, at most rows / small groups
    among = None
    for c, k in name_of.items():
        here = F.col(c).eqNullSafe(F.col(k))
        among = here if among is None else among & here
    few = told if n_large == 0 or not by else told.join(keys(large), among, "left_anti")
    at_once = few.groupBy(*by).agg(F.percentile("_value", F.array(*[F.lit(float(q)) for q in shares.values()])).alias("_q"))
    plain = at_once.select(*by, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(shares)])
    if n_large == 0:
        return plain
    many = told if not by else told.join(keys(large), among, "left_semi")
    refined = _refined(many.select(*by, ordered_bits(F.col("_value")).alias("_b")), large, by, shares)
    return plain.unionByName(refined) if by else refined


def _refined(keyed, n, by, shares):
    """exact_percentiles of the bits of values (_b) of groups of any size, whose numbers of values are n (_n)."""
    keyed = written(keyed, "bits")
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares.values()])))
    at = written(n.withColumn("_rank", F.explode(ranks)).withColumns({"_known": F.lit(0).cast("long"), "_left": F.col("_rank")}), "ranks")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]

    def met(a, b, *more):
        out = None
        for c in [*same(a, b), *more]:
            out = c if out is None else out & c
        return out

    for step in range(1, 64 // BITS + 1):
        prefix = F.shiftright("r._b", 64 - BITS * step)
        before = F.shiftright("r._b", 64 - BITS * (step - 1)) if step > 1 else F.lit(0).cast("long")
        wanted = at.select(*by, "_known").distinct()
        bins = keyed.alias("r").join(wanted.alias("w"), met("r", "w", before == F.col("w._known")))
        bins = bins.groupBy(*[F.col(f"r.{c}").alias(c) for c in by], F.col("w._known").alias("_known"), prefix.alias("_next")).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*by, "_known").orderBy("_next")
        bins = bins.withColumn("_upto", F.sum("_c").over(w))
        inside = (F.col("a._left") < F.col("b._upto")) & (F.col("a._left") >= F.col("b._upto") - F.col("b._c"))
        hit = at.alias("a").join(bins.alias("b"), met("a", "b", F.col("a._known") == F.col("b._known"), inside))
        at = written(hit.select(*[F.col(f"a.{c}").alias(c) for c in by], "a._n", "a._rank", F.col("b._next").alias("_known"), (F.col("a._left") - F.col("b._upto") + F.col("b._c")).alias("_left")), "ranks")
    found = at.withColumn("_v", from_bits(F.col("_known"))).groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"))
    low, high = (lambda q: F.element_at("_of", F.floor(place(q)))), (lambda q: F.element_at("_of", F.ceil(place(q))))
    return found.select(*by, *[(low(q) + F.when(high(q) != low(q), (high(q) - low(q)) * (place(q) - F.floor(place(q)))).otherwise(0.0)).alias(name) for name, q in shares.items()])
