"""Evaluation: scores, folds, grids, paired tests, multiple testing, error tables."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideforge.operators import logistic, models, splits
from strideforge.operators.leave_out import evaluate_held_out
from strideforge.operators.store import written
from strideforge.schemas import BLOCKS, REPEATS, WILSON_Z


def wilson(n_correct, n, z=WILSON_Z):
    """Columns (low, high) of the Wilson interval, within 0..1; null for n = 0."""
    p = F.try_divide(n_correct, n)
    z2 = z * z
    mid = (p + F.try_divide(F.lit(z2), 2 * n)) / (1 + F.try_divide(F.lit(z2), n))
    half = F.try_divide(F.lit(z), 1 + F.try_divide(F.lit(z2), n)) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def confusion(predicted, by=()):
    return predicted.groupBy(*by, "label", "pred").count()


def score(predicted, by=()):
    """Accuracy, Wilson interval, Wald standard error, n, n_correct; rows without a prediction are left out."""
    n, good = F.col("n").cast("double"), F.col("n_correct").cast("double")
    s = predicted.filter("pred is not null").groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") == F.col("pred")).cast("long")), F.lit(0)).alias("n_correct"))
    low, high = wilson(good, n)
    p = F.try_divide(good, n)
    return s.withColumns({"accuracy": p, "low": low, "high": high, "wald_se": F.sqrt(F.try_divide(p * (1 - p), n))})


def precision_recall(predicted, by=()):
    """Precision and recall per class; null where nothing was predicted or labelled."""
    rows = predicted.filter("pred is not null").withColumn("c", F.explode(F.array_distinct(F.array("label", "pred"))))
    hit, said, there = (F.col("label") == F.col("pred")), F.col("pred") == F.col("c"), F.col("label") == F.col("c")
    n = lambda x: F.sum(x.cast("long"))
    return rows.groupBy(*by, F.col("c").alias("label")).agg(
        F.try_divide(n(hit & said), n(said)).alias("precision"), F.try_divide(n(hit & there), n(there)).alias("recall")
    )


def evaluate_folds(rows, assignment, features, kind="qda"):
    """Predictions of the test rows of every fold: fold, row_id, label, pred, and the reasons of folds that failed.

    All folds are fitted from one aggregate keyed by fold and label; test rows meet their fold's model in NumPy batches.
    Rows with a missing feature take no part on either side. For splits that test each row once at most, ``evaluate_held_out``
    does the same without a row for each fold.
    """
    whole = models._complete(rows, features).join(assignment, "row_id")
    stats = models.class_stats(whole.filter("side = 'train'"), features, "label", ["fold"]).collect()  # folds x classes rows
    by_fold = {}
    for r in stats:
        by_fold.setdefault(r["fold"], []).append(r)
    test, failed, fitted = whole.filter("side = 'test'"), {}, {}
    for fold, some in sorted(by_fold.items()):
        try:
            fitted[fold] = models.from_stats(kind, some, len(features))
        except ValueError as e:
            failed[fold] = str(e)
    out = models.predict_batches(test.select("fold", "row_id", "label", "session", *features), fitted, features, "fold")
    return out.select("fold", "row_id", "label", "session", "pred"), failed


def cross_validation(rows, features, kind="qda", k=BLOCKS, repeats=REPEATS):
    """Accuracy over k contiguous blocks (pooled; least and best block) and over repeated random splits (mean, least, best)."""
    spread = lambda p, name, mean: (
        score(p, ["fold"]).agg(F.count("*").alias("folds"), mean.alias("accuracy"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most")).withColumn("scheme", F.lit(name))
    )
    blocks = evaluate_held_out(splits.block_of(rows, k), features, kind)[0]
    random = evaluate_folds(rows, splits.random_split(rows, repeats=repeats), features, kind)[0]
    pooled = F.try_divide(F.sum("n_correct"), F.sum("n"))
    return spread(blocks, "blocks", pooled).unionByName(spread(random, "random", F.avg("accuracy")))


def grid(rows, sets, kinds=("lda", "qda", "logistic"), k=BLOCKS):
    """Block-CV predictions of every cell: rep, fset, kind, fold, row_id, label, session, pred.

    rows: features of all representations, stacked, with a column rep; sets: name -> features. For each set one aggregate by
    (rep, fold, label) fits all discriminants, and each Newton step of all logistic regressions is one aggregate as well.
    """
    out = None
    placed = written(splits.block_of(rows, k, ["rep"]).withColumn("fold", F.col("fold").cast("int")), "placed")
    for name, features in sets.items():
        whole = models._complete(placed, features)
        stats = {}
        for r in models.class_stats(whole, features, "label", ["rep", "fold"]).collect():  # representations x folds x classes rows
            stats.setdefault(r["rep"], []).append(r)
        for kind in kinds:
            if kind == "logistic":
                fitted = logistic.fit_without(whole, stats, features)
            else:
                fitted = {(rep, f): m for rep, some in stats.items() for f, m in models.fit_without(some, len(features), kind)[0].items()}
            test = whole.withColumn("_cell", F.concat_ws("/", "rep", "fold")).select("_cell", "rep", "fold", "row_id", "label", "session", *features)
            fitted = {f"{rep}/{f}": m for (rep, f), m in fitted.items()}
            predict = logistic.predict_batches if kind == "logistic" else models.predict_batches
            part = predict(test, fitted, features, "_cell").select("rep", F.lit(name).alias("fset"), F.lit(kind).alias("kind"), "fold", "row_id", "label", "session", "pred")
            out = part if out is None else out.unionByName(part)
    return out


def mcnemar(a, b):
    """Paired table of two predictions of the same rows: both right, only a, only b, neither."""
    p = a.select("row_id", "label", F.col("pred").alias("pa")).join(b.select("row_id", F.col("pred").alias("pb")), "row_id")
    ra, rb = F.col("pa") == F.col("label"), F.col("pb") == F.col("label")
    n = lambda x, name: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(name)
    return p.agg(n(ra & rb, "a"), n(ra & ~rb, "b"), n(~ra & rb, "c"), n(~ra & ~rb, "d"))


def binomial_two_sided(b, c):
    """Exact two-sided p of b against c at odds of one half, and the smallest that b + c discordant pairs can give."""
    n = b + c
    if not n:
        return 1.0, 1.0
    tail = sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n
    return min(1.0, 2 * tail), min(1.0, 2 / 2**n)


def holm(tests, p="p"):
    """tests with p_holm: Holm-adjusted p-values over the whole table, of any size; nulls stay null.

    Rows are dealt out by ranges of p. The driver sees the number of rows and the greatest raised value of each range, from which
    a range's first rank and least value follow; ranks and running maxima are taken inside the ranges.
    """
    known = tests.filter(F.col(p).isNotNull())
    order = [p, *[c for c in tests.columns if c != p]]
    rows = written(known.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "by-p")
    w = Window.partitionBy("_part").orderBy(*order)
    counts = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}  # a row for each range
    total, first, so_far = sum(counts.values()), {}, 0
    for part in sorted(counts):
        first[part] = so_far
        so_far += counts[part]
    of = lambda by_part, default: F.element_at(F.create_map(*[F.lit(x) for kv in by_part.items() for x in kv]), F.col("_part")) if by_part else F.lit(default)
    ranked = rows.withColumn("_v", (F.lit(total) - of(first, 0) - F.row_number().over(w) + 1) * F.col(p))
    ranked = written(ranked.withColumn("_raised", F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))), "ranked")
    greatest = {r[0]: r[1] for r in ranked.groupBy("_part").agg(F.max("_v")).collect()}  # a row for each range
    before, most = {}, 0.0
    for part in sorted(greatest):
        before[part] = most
        most = max(most, greatest[part])
    done = ranked.withColumn("p_holm", F.least(F.greatest("_raised", of(before, 0.0)), F.lit(1.0))).drop("_part", "_v", "_raised")
    return done.unionByName(tests.filter(F.col(p).isNull()), allowMissingColumns=True)


def overlap_fractions(a_low, a_high, b_low, b_high):
    """Shares of the first and the second interval that both hold."""
    both = F.greatest(F.least(F.col(a_high), F.col(b_high)) - F.greatest(F.col(a_low), F.col(b_low)), F.lit(0.0))
    return F.try_divide(both, F.col(a_high) - F.col(a_low)), F.try_divide(both, F.col(b_high) - F.col(b_low))


def per_session(predicted, by=()):
    """Accuracy per session, and over sessions: their mean, standard error (sample sd over root n) and its ratio to the row-level one."""
    each = predicted.filter("pred is not null").groupBy(*by, "session").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    total = F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")
    out = each.groupBy(*by).agg(F.count("*").alias("n_sessions"), F.avg("accuracy").alias("mean_accuracy"), (F.stddev_samp("accuracy") / F.sqrt(F.count("*"))).alias("session_se"), total.alias("_p"), F.sum("n").alias("_n"))
    wald = F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("_n"))
    return out.withColumn("se_ratio", F.try_divide(F.col("session_se"), wald)).drop("_p", "_n")


def errors(predicted, rows, features):
    """Misclassified rows with their features."""
    wrong = predicted.filter("pred is not null and pred <> label").select("row_id", "fold", "pred")
    return wrong.join(rows.select("row_id", "label", *features), "row_id")


def error_profile(errors_, rows, features, shares=(), lengths=()):
    """Per (label, pred): count, mean of each feature, and whether it lies nearer the predicted class's mean.

    shares (such as s4_zero_frac) and lengths (such as contact_time_s) are averaged over the errors too, the former beside the
    means of both classes, the latter beside their medians: own_<name> and other_<name>.
    """
    extra = [*shares, *lengths]
    means = rows.groupBy("label").agg(*[F.avg(f).alias(f"m_{f}") for f in [*features, *shares]], *[F.median(f).alias(f"m_{f}") for f in lengths])
    prof = errors_.groupBy("label", "pred").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in [*features, *extra]])
    own = means.select("label", *[F.col(f"m_{f}").alias(f"own_{f}") for f in [*features, *extra]])
    other = means.select(F.col("label").alias("pred"), *[F.col(f"m_{f}").alias(f"other_{f}") for f in [*features, *extra]])
    joined = prof.join(F.broadcast(own), "label").join(F.broadcast(other), "pred")  # one row a class on each small side
    nearer = {f"nearer_pred_{f}": F.abs(F.col(f) - F.col(f"other_{f}")) < F.abs(F.col(f) - F.col(f"own_{f}")) for f in features}
    beside = [c for f in extra for c in (f, f"own_{f}", f"other_{f}")]
    return joined.withColumns(nearer).select("label", "pred", "n", *features, *nearer, *beside)


def first_errors(predicted, limit=12):
    """The first errors of every (label, pred) pair by row_id."""
    w = Window.partitionBy("label", "pred").orderBy("row_id")
    return predicted.filter("pred <> label").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def choose_cell(cells):
    """The best cell: score rounded to 6 places, then raw, gain_matched, conductance, then lda, qda; finite scores of the CoP features."""
    rep = F.when(F.col("rep") == "raw", 0).when(F.col("rep") == "gain_matched", 1).otherwise(2)
    fair = cells.filter("fset = 'cop' and kind in ('lda', 'qda') and accuracy is not null and not isnan(accuracy)")
    return fair.orderBy(F.desc(F.round("accuracy", 6)), rep, "kind").limit(1)
