"""Multinomial logistic regressions of many cells at once: every Newton step of all of them is one aggregate over the rows.

Features are z-scored by the training rows of each cell (population deviation, 0 counts as 1); the penalty is half the sum of
squared weights without the intercepts, against the sum of the rows' losses.
"""

import numpy as np
from pyspark.sql import functions as F

from strideforge.operators.store import written

STEPS, TOLERANCE = 25, 1e-9


def scales(stats, p, fold):
    """Classes, mean and population deviation of the rows outside a fold, from collected class statistics."""
    rest = [r for r in stats if r["fold"] != fold]
    n = sum(r["n"] for r in rest)
    mean = sum(r["n"] * np.array([r[f"m_{i}"] for i in range(p)]) for r in rest) / n
    inner = sum((r["n"] - 1) * np.array([r[f"c_{i}_{i}"] or 0.0 for i in range(p)]) + r["n"] * (np.array([r[f"m_{i}"] for i in range(p)]) - mean) ** 2 for r in rest)
    sd = np.sqrt(inner / n)
    return sorted({r["label"] for r in rest}), mean, np.where(sd > 0, sd, 1.0)


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def step_sums(x, y, w):
    """Gradient and Hessian (flat) of the summed losses: x (n, p + 1) with a leading 1, y class numbers, w (classes, p + 1)."""
    p = softmax(x @ w.T)
    k, d = w.shape
    hot = np.zeros_like(p)
    hot[np.arange(len(y)), y] = 1
    gradient = (p - hot).T @ x
    hessian = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(k):
            hessian[a, :, b, :] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
    return np.concatenate([gradient.ravel(), hessian.reshape(k * d, k * d).ravel()])


def packed_sums(u, products, y, w, of):
    """``step_sums`` of the rows where of is 1, without what repeats: the gradient, then the Hessian's blocks of class pairs a <= b,
    each as its entries i <= j. products: u[:, i] * u[:, j] for all i <= j, so that a pair is a product of matrices.
    """
    p = softmax(u @ w.T) * of[:, None]
    hot = np.zeros_like(p)
    hot[np.arange(len(y)), y] = of
    a, b = np.triu_indices(len(w))
    weights = p[:, a] * ((a == b) - p[:, b])
    return np.concatenate([((p - hot).T @ u).ravel(), (weights.T @ products).ravel()])


def unpacked_sums(packed, k, d, turn):
    """The form of ``step_sums`` of ``packed_sums`` for k classes, in the features turn @ u."""
    (a, b), (i, j) = np.triu_indices(k), np.triu_indices(d)
    hessian = np.zeros((k, d, k, d))
    for x, y, row in zip(a, b, packed[k * d :].reshape(len(a), len(i))):
        block = np.zeros((d, d))
        block[i, j] = block[j, i] = row
        hessian[x, :, y, :] = hessian[y, :, x, :] = turn @ block @ turn.T
    return np.concatenate([(packed[: k * d].reshape(k, d) @ turn.T).ravel(), hessian.reshape(k * d, k * d).ravel()])


def turned(mean, sd, scaled):
    """The matrix that takes (1, features scaled by the other mean and deviation) to (1, features scaled by mean and sd)."""
    out = np.diag(np.concatenate([[1.0], scaled[1] / sd]))
    out[1:, 0] = (scaled[0] - mean) / sd
    return out


def newton(sums, w):
    """The weights after one step, and the largest change. The intercepts' common shift is held by a small ridge of its own."""
    k, d = w.shape
    penalty = np.ones_like(w)
    penalty[:, 0] = 1e-9
    gradient = sums[: k * d] + (penalty * w).ravel()
    hessian = sums[k * d :].reshape(k * d, k * d) + np.diag(penalty.ravel())
    change = np.linalg.solve(hessian, gradient).reshape(k, d)
    return w - change, np.abs(change).max()


def fit_without(rows, stats, features, steps=STEPS, tolerance=TOLERANCE):
    """Models by (rep, fold), each on the rows of a representation outside a fold. rows: rep, fold, label, features; stats by rep.

    Rows are written once as numbers. A step adds up all cells over a task's rows, so a task gives cells x (p + 1)**2 numbers once,
    and products of features are taken once for all folds: a representation's rows are scaled alike, a cell's own scale is a matrix.
    """
    p = len(features)
    cells, scale, reps = {}, {}, sorted(stats)
    labels = sorted({r["label"] for some in stats.values() for r in some})
    for rep, some in stats.items():
        scale[rep] = scales(some, p, object())[1:]
        for fold in sorted({r["fold"] for r in some}):
            classes, mean, sd = scales(some, p, fold)
            cells[rep, fold] = {"classes": classes, "mean": mean, "sd": sd, "w": np.zeros((len(classes), p + 1))}
    place = lambda c, known: F.array_position(F.array(*[F.lit(x) for x in known]), F.col(c)).cast("int") - 1
    xs = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    coded = written(rows.select(place("rep", reps).alias("rep"), F.col("fold").cast("int").alias("fold"), place("label", labels).alias("y"), *xs), "newton")
    upper = np.triu_indices(p + 1)
    todo = dict(cells)
    for _ in range(steps):
        if not todo:
            break
        now = []
        for at, (rep, fold) in enumerate(todo):
            c = todo[rep, fold]
            c["turn"] = turned(c["mean"], c["sd"], scale[rep])
            now.append((at, reps.index(rep), fold, np.searchsorted(c["classes"], labels), c["w"] @ c["turn"]))
        scaled = [scale[rep] for rep in reps]

        def run(batches, now=now, scaled=scaled):
            import pyarrow as pa

            sums = {}
            for batch in batches:
                rep, fold, y = (np.asarray(batch.column(c)) for c in ("rep", "fold", "y"))
                x = np.column_stack([np.asarray(batch.column(f"x{i}")) for i in range(p)])
                for r, (mean, sd) in enumerate(scaled):
                    mine = np.flatnonzero(rep == r)
                    if not len(mine):
                        continue
                    u = np.column_stack([np.ones(len(mine)), (x[mine] - mean) / sd])
                    products = u[:, upper[0]] * u[:, upper[1]]
                    for at, of, out, class_of, w in now:
                        if of == r:
                            held = fold[mine] != out
                            known = np.where(held, class_of[y[mine]], 0)
                            sums[at] = sums.get(at, 0.0) + packed_sums(u, products, known, w, held.astype(float))
            for at, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), at, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["cell", "i", "v"])

        # cells x (p + 1)**2 numbers: a bounded result
        got = coded.mapInArrow(run, "cell int, i int, v double").groupBy("cell", "i").agg(F.sum("v").alias("v")).toPandas()
        keys = list(todo)
        for at, some in got.groupby("cell"):
            cell = todo[keys[at]]
            sums = unpacked_sums(some.sort_values("i").v.to_numpy(), len(cell["classes"]), p + 1, cell.pop("turn"))
            cell["w"], change = newton(sums, cell["w"])
            if change < tolerance:
                del todo[keys[at]]
    return cells


def predict_batches(rows, fitted, features, key):
    """rows with pred by the model for the value of the column key; null where there is none."""
    names = rows.columns

    def run(batches):
        for pdf in batches:
            pred = np.full(len(pdf), None, object)
            for k, m in fitted.items():
                at = np.flatnonzero((pdf[key] == k).to_numpy())
                if len(at):
                    x = np.column_stack([np.ones(len(at)), (pdf[features].to_numpy(float)[at] - m["mean"]) / m["sd"]])
                    pred[at] = np.array(m["classes"], object)[np.argmax(x @ m["w"].T, 1)]
            yield pdf.assign(pred=pred)[[*names, "pred"]]

    return rows.mapInPandas(run, rows.select("*", F.lit(None).cast("string").alias("pred")).schema)
