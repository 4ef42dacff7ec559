"""Discriminant classifiers: statistics by one aggregate, p x p algebra on the driver, scores as column expressions."""

import json
import math
import warnings

import numpy as np
from pyspark.sql import functions as F

from strideforge.schemas import MODEL, RANK_TOLERANCE


def class_stats(rows, features, label="label", by=()):
    """Per class: n, means and the sample covariances of the features, one row a class (and key)."""
    aggs = [F.count("*").alias("n"), *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)]]
    for i, a in enumerate(features):
        aggs += [F.covar_samp(a, b).alias(f"c_{i}_{j}") for j, b in enumerate(features) if j >= i]
    return rows.groupBy(*by, label).agg(*aggs)


def _collected(stats, p, label):
    """Statistics as arrays by sorted class: at most a few classes of p + p * p numbers."""
    rows = sorted(stats, key=lambda r: r[label])
    means = np.array([[r[f"m_{i}"] for i in range(p)] for r in rows], float)
    covs = np.zeros((len(rows), p, p))
    for k, r in enumerate(rows):
        for i in range(p):
            for j in range(i, p):
                covs[k, i, j] = covs[k, j, i] = float("nan") if r[f"c_{i}_{j}"] is None else r[f"c_{i}_{j}"]
    return [r[label] for r in rows], means, covs, np.array([r["n"] for r in rows], float)


def from_stats(kind, stats, p, label="label", reg=0.0, meta=None):
    """A model document from collected class statistics."""
    classes, means, covs, n = _collected(stats, p, label)
    model = {"kind": kind, "classes": [str(c) for c in classes], "means": means.tolist(), "priors": (n / n.sum()).tolist(), "counts": [int(x) for x in n], "meta": meta or {}}
    eye = reg * np.eye(p)
    if kind == "lda":
        pooled = sum((k - 1) * c for k, c in zip(n, covs) if k > 1) / (n.sum() - len(n))
        model["cov"] = (pooled + eye).tolist()
        return model
    if kind != "qda":
        raise ValueError(f"unknown kind of model: {kind}")
    for c, k, cov in zip(classes, n, covs):
        if k <= 1 or k <= p:
            raise ValueError(f"class {c} has {int(k)} rows, too few for {p} features")
        if np.linalg.eigvalsh(cov).min() <= RANK_TOLERANCE:
            warnings.warn(f"the covariance of class {c} is close to singular", stacklevel=2)
    model["covs"] = [(c + eye).tolist() for c in covs]
    return model


def finite(features):
    """Whether all features are there and finite; others count as missing in fits and predictions alike."""
    out = F.lit(True)
    for f in features:
        x = F.col(f).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return out


def _complete(rows, features):
    return rows.filter(finite(features))


def fit_without(stats, p, kind, label="label", fold="fold"):
    """Models by fold, each fitted on all rows but the fold's own, and the reasons of those that failed.

    stats: collected ``class_stats`` by fold and label; counts, sums and scatters of a class less those of a fold give the rest's.
    """
    parts = {}
    for r in stats:
        n, mean = r["n"], np.array([r[f"m_{i}"] for i in range(p)], float)
        scatter = np.zeros((p, p))
        if n > 1:
            for i in range(p):
                for j in range(i, p):
                    scatter[i, j] = scatter[j, i] = r[f"c_{i}_{j}"] * (n - 1)
        parts.setdefault(r[label], []).append((r[fold], n, mean, scatter))
    totals = {}
    for c, some in parts.items():
        n = sum(x[1] for x in some)
        mean = sum(x[1] * x[2] for x in some) / n
        totals[c] = n, mean, sum(x[3] + x[1] * np.outer(x[2] - mean, x[2] - mean) for x in some), {x[0]: x[1:] for x in some}
    fitted, failed = {}, {}
    for f in sorted({r[fold] for r in stats if r[fold] is not None}):
        rows = []
        for c, (n, mean, scatter, own) in totals.items():
            if f in own:
                k, u, inner = own[f]
                if k == n:
                    continue
                rest = (n * mean - k * u) / (n - k)
                scatter = scatter - inner - (k * (n - k) / n) * np.outer(u - rest, u - rest)
                n, mean = n - k, rest
            cov = {f"c_{i}_{j}": scatter[i, j] / (n - 1) if n > 1 else None for i in range(p) for j in range(i, p)}
            rows.append({label: c, "n": n, **{f"m_{i}": mean[i] for i in range(p)}, **cov})
        try:
            fitted[f] = from_stats(kind, rows, p, label)
        except ValueError as e:
            failed[f] = str(e)
    return fitted, failed


def fit(rows, features, kind="qda", label="label", reg=0.0, meta=None):
    """LDA or QDA over the complete rows."""
    stats = class_stats(_complete(rows, features), features, label).collect()  # a row for each class
    return from_stats(kind, stats, len(features), label, reg, {"features": ",".join(features), **(meta or {})})


def class_scores(model, features):
    """A column of the score of each class: -1/2 Mahalanobis - 1/2 log determinant + log prior; null if a feature is."""
    out = []
    for k, c in enumerate(model["classes"]):
        cov = np.array(model["cov"] if model["kind"] == "lda" else model["covs"][k], float)
        try:
            np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            raise ValueError(f"the covariance of class {c} is not positive definite") from None
        inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        d = [F.col(f) - float(m) for f, m in zip(features, model["means"][k])]
        quad = F.lit(0.0)
        for i in range(len(d)):
            for j in range(len(d)):
                quad = quad + d[i] * d[j] * float(inverse[i, j])
        out.append(quad * -0.5 + (-0.5 * logdet + math.log(model["priors"][k])))
    return out


#: Beyond so many features a score is computed by NumPy in batches instead of p * p column terms.
MAX_TERMS = 3


def predict_batches(rows, by_key, features, key=None):
    """rows with pred, by NumPy: by_key gives the model for the value of the column key (or for None)."""
    names = rows.columns
    fitted = {}
    for k, m in by_key.items():
        covs = [m["cov"]] * len(m["classes"]) if m["kind"] == "lda" else m["covs"]
        fitted[k] = m["classes"], [(np.array(u), np.linalg.inv(c), np.linalg.slogdet(c)[1], math.log(q)) for u, c, q in zip(m["means"], covs, m["priors"])]

    def run(batches):
        for pdf in batches:
            pred = np.full(len(pdf), None, object)
            x = pdf[features].to_numpy(float)
            known = np.isfinite(x).all(1)
            for k, (classes, parts) in fitted.items():
                at = np.flatnonzero(known & (pdf[key] == k).to_numpy()) if key else np.flatnonzero(known)
                d = [x[at] - u for u, *_ in parts]
                s = [-0.5 * np.einsum("ij,jk,ik->i", v, inv, v) - 0.5 * logdet + prior for v, (_, inv, logdet, prior) in zip(d, parts)]
                pred[at] = np.array(classes, object)[np.argmax(np.array(s), 0)]
            yield pdf.assign(pred=pred)[[*names, "pred"]]

    return rows.mapInPandas(run, rows.select("*", F.lit(None).cast("string").alias("pred")).schema)


def predict(rows, model, features):
    """rows with pred: the class of the highest score, ties to the first; null where a feature is missing or not finite."""
    if len(features) > MAX_TERMS:
        return predict_batches(rows, {None: model}, features)
    scores = F.array(*class_scores(model, features))
    place = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return rows.withColumn("pred", F.when(finite(features), F.get(F.array(*map(F.lit, model["classes"])), place)))


def pooled_eigen(model):
    """Eigenvalues, descending, of the covariance pooled with weights n - 1."""
    if model["kind"] == "lda":
        cov = np.array(model["cov"])
    else:
        n = np.array(model["counts"], float)
        cov = np.tensordot(n - 1, np.array(model["covs"]), 1) / (n.sum() - len(n))
    return np.linalg.eigvalsh(cov)[::-1]


def condition_numbers(rows, features):
    """Condition numbers of the features' covariance, as they are and z-scored."""
    p = len(features)
    one = rows.withColumn("_all", F.lit("all"))
    _, _, covs, _ = _collected(class_stats(_complete(one, features), features, "_all").collect(), p, "_all")
    sd = np.sqrt(np.diag(covs[0]))
    z = covs[0] / np.outer(sd, sd)
    return tuple(float(np.linalg.cond(c)) for c in (covs[0], z))


def standardised(rows, features, base=None):
    """rows with z_<feature>: population z-scores by base's mean and deviation (a deviation of 0 counts as 1)."""
    base = rows if base is None else base
    s = base.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    return rows.withColumns({f"z_{f}": (F.col(f) - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i, f in enumerate(features)})


def fit_logistic(rows, features, label="label"):
    """Multinomial logistic regression on z-scores with an L2 penalty of 1/n, by Spark's trainer: (model, classes)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    z = standardised(_complete(rows, features), features)
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    data = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_x").transform(z).withColumn("_y", y.cast("double"))
    n = data.count()
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, family="multinomial").fit(data), classes


def predict_logistic(rows, fitted, features, base):
    from pyspark.ml.feature import VectorAssembler

    model, classes = fitted
    z = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_x").transform(standardised(_complete(rows, features), features, base))
    out = model.setPredictionCol("_k").transform(z)
    return out.withColumn("pred", F.get(F.array(*[F.lit(c) for c in classes]), F.col("_k").cast("int"))).drop("_x", "_k", "rawPrediction", "probability")


def save_model(spark, model, path, meta=None):
    """Write a model document as one row of JSON."""
    doc = {"cov": None, "covs": None, **model, "meta": {k: str(v) for k, v in {**model.get("meta", {}), **(meta or {})}.items()}}
    spark.createDataFrame([tuple(doc[f.name] for f in MODEL.fields)], MODEL).coalesce(1).write.mode("overwrite").json(path)


def load_model(spark, path):
    """Read a model document; an unknown kind and a missing covariance are refused."""
    row = spark.read.schema(MODEL).json(path).first()
    doc = json.loads(json.dumps(row.asDict(recursive=True)))
    need = {"lda": "cov", "qda": "covs"}.get(doc["kind"])
    if need is None:
        raise ValueError(f"unknown kind of model: {doc['kind']!r}")
    if doc[need] is None:
        raise ValueError("the model has no covariance")
    return doc


def deployment_fit(rows, features, kind, train, test, meta=None, label="label"):
    """Fit on train and score on test as a check, then fit on all rows with the check's score in the meta."""
    check = predict(_complete(test, features), fit(train, features, kind, label), features)
    score = check.agg(F.avg((F.col("pred") == F.col(label)).cast("double"))).first()[0]
    return fit(rows, features, kind, label, meta={**(meta or {}), "check_accuracy": score})
