"""Models of very many folds, each fitted on all rows but its own: true subtraction, and no fold passes through the driver.

Counts, sums and products of the features, taken from each class's mean so that nothing cancels, are a table by fold and class.
Their totals are a row for each class; the statistics behind a fold's model are the totals less its own row, so the work is one
aggregate over the rows and a p x p inversion for each class and fold, inside the tasks. Rows meet the model of the fold that tests
them in one exchange by fold: models come first and then their rows pass by, so a task holds one model and a batch. Where folds are
few, each is dealt to several tasks.
"""

import numpy as np
from pyspark.sql import functions as F

from strideforge.operators import models
from strideforge.operators.store import written

#: Classes (rows that pass through the driver and are sent to all tasks), and tasks that the rows of few folds are dealt to.
MAX_CLASSES, SPREAD = 1000, 256
FITTED = "fold int, classes array<string>, means array<double>, inverses array<double>, constants array<double>, reason string, note string"


def _pairs(p):
    return [(i, j) for i in range(p) for j in range(i, p)]


def fold_stats(rows, features, label="label", fold="fold"):
    """(stats by fold and class: n, s, q; class means): sums and products about the means of the classes over all rows."""
    p = len(features)
    mean = rows.groupBy(label).agg(*[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)])
    means = {r[0]: np.array(r[1:], float) for r in mean.limit(MAX_CLASSES + 1).collect()}  # a row for each class
    if len(means) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    table = rows.sparkSession.createDataFrame([(k, m.tolist()) for k, m in means.items()], f"_class {rows.schema[label].dataType.simpleString()}, _mean array<double>")
    centred = rows.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_class"))).select(fold, label, *[(F.col(f) - F.get("_mean", F.lit(i))).alias(f"_d{i}") for i, f in enumerate(features)])
    sums = F.array(*[F.sum(f"_d{i}") for i in range(p)]).alias("s")
    products = F.array(*[F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in _pairs(p)]).alias("q")
    return centred.groupBy(fold, label).agg(F.count("*").alias("n"), sums, products), means


def fitted_without(rows, features, kind="qda", label="label"):
    """A row for each fold: its model on all rows outside it (classes, means, inverse covariances, constants), or the reason of none."""
    p = len(features)
    stats, means = fold_stats(rows, features, label)
    stats = written(stats, "fold-stats")
    add = lambda c, k: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(k)]).alias(c)
    totals = {r[label]: (r["n"], np.array(r["s"]), np.array(r["q"])) for r in stats.groupBy(label).agg(F.sum("n").alias("n"), add("s", p), add("q", len(_pairs(p)))).collect()}  # a row for each class
    own = stats.filter("fold is not null").groupBy(F.col("fold").cast("int").alias("fold")).agg(F.collect_list(F.struct(F.col(label).alias("label"), "n", "s", "q")).alias("own"))
    order = sorted(totals, key=str)

    def model(own):
        here = {o["label"]: o for o in own}
        some = []
        for c in order:
            n, s, q = totals[c]
            if c in here:
                n, s, q = n - here[c]["n"], s - np.array(here[c]["s"]), q - np.array(here[c]["q"])
            if n > 0:
                row = {"label": c, "n": n} | {f"m_{i}": means[c][i] + s[i] / n for i in range(p)}
                some.append(row | {f"c_{i}_{j}": (q[k] - s[i] * s[j] / n) / (n - 1) if n > 1 else None for k, (i, j) in enumerate(_pairs(p))})
        return models.from_stats(kind, some, p)

    def run(batches):
        import warnings

        import pandas as pd

        for pdf in batches:
            out = []
            for fold, own in zip(pdf["fold"], pdf["own"]):
                row = dict.fromkeys(c.split()[0] for c in FITTED.split(", ")) | {"fold": fold}
                try:
                    with warnings.catch_warnings(record=True) as told:
                        warnings.simplefilter("always")
                        m = model(own)
                    covs = [np.array(m["cov"])] * len(m["classes"]) if m["kind"] == "lda" else list(map(np.array, m["covs"]))
                    constants = [-0.5 * np.linalg.slogdet(c)[1] + np.log(q) for c, q in zip(covs, m["priors"])]
                    inverses = np.concatenate([np.linalg.inv(c).ravel() for c in covs])
                    row |= {"classes": m["classes"], "means": np.ravel(m["means"]).tolist(), "inverses": inverses.tolist(), "constants": constants, "note": "; ".join(str(w.message) for w in told) or None}
                except (ValueError, np.linalg.LinAlgError) as e:
                    row["reason"] = str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=list(row)) if out else pd.DataFrame()

    return own.mapInPandas(run, FITTED)


def predict_held_out(rows, fitted, features, keep=("row_id", "label", "session")):
    """fold, keep and pred of rows(fold, row_id, features) by the models of their folds; null without a model."""
    p, keep = len(features), list(keep)
    folds = fitted.filter("reason is null")
    spread = max(1, SPREAD // max(1, folds.count()))
    ready = folds.drop("reason", "note").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("_row", F.lit(0))
    there = rows.filter("fold is not null").select(F.col("fold").cast("int").alias("fold"), *keep, *[F.col(f).cast("double").alias(f) for f in features])
    there = there.withColumns({"_salt": F.pmod(F.xxhash64("row_id"), F.lit(spread)).cast("int"), "_row": F.lit(1)})
    both = there.unionByName(ready, allowMissingColumns=True).repartition("fold", "_salt").sortWithinPartitions("fold", "_salt", "_row")
    out = rows.select(F.col("fold").cast("int").alias("fold"), *keep, F.lit(None).cast("string").alias("pred"))

    def run(batches):
        key, classes, means, inverses, constants = None, None, None, None, None
        for pdf in batches:
            is_model = (pdf["_row"] == 0).to_numpy()
            fold = pdf["fold"].to_numpy()
            x = pdf[features].to_numpy(float)
            pred = np.full(len(pdf), None, object)
            starts = np.unique(np.concatenate([[0], np.flatnonzero(is_model)])) if len(pdf) else []
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if is_model[a]:
                    r = pdf.iloc[a]
                    key, classes, constants = r["fold"], np.array(r["classes"], object), np.array(r["constants"], float)
                    means, inverses = np.array(r["means"], float).reshape(-1, p), np.array(r["inverses"], float).reshape(-1, p, p)
                    a += 1
                at = np.arange(a, b)[fold[a:b] == key]  # rows behind another fold's model have none
                d = x[at, None, :] - means[None] if len(at) else None
                if d is not None:
                    score = -0.5 * np.einsum("nki,kij,nkj->nk", d, inverses, d) + constants
                    pred[at] = classes[np.argmax(score, 1)]
            yield pdf[["fold", *keep]].assign(pred=pred)[~is_model]

    return both.mapInPandas(run, out.schema)


def evaluate_held_out(rows, features, kind="qda"):
    """(predictions, fits) of rows with a column fold, the only one that tests them (null: none does); all others train on them.

    predictions: fold, row_id, label, session, pred. fits: fold, reason (null: fitted), note (warnings of the fit).
    """
    whole = models._complete(rows, features)
    fitted = written(fitted_without(whole, features, kind), "fold-models")
    return predict_held_out(whole, fitted, features), fitted.select("fold", "reason", "note")
