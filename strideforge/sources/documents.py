"""Small documents and catalogues: manifests, gain matches, calibrations, sessions by file name, fingerprints."""

from pyspark.sql import functions as F

from strideforge.operators.models import load_model, save_model  # noqa: F401
from strideforge.schemas import CALIBRATION, FULL_SCALE, GAIN_MATCH, MANIFEST


def read_manifest(spark, path):
    """The calibration manifest: header and blank lines are left out; a short row, a field that does not parse, no rows: errors."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    names = MANIFEST.names
    f = F.split("value", ",", -1)
    body = lines.filter(F.trim(F.get(f, F.lit(0))) != names[0])
    short = F.raise_error(F.concat(F.lit("a row of the manifest has too few fields: "), "value"))
    cells = body.withColumn("f", F.when(F.size(f) == len(names), f).otherwise(short))
    bad = lambda n: F.raise_error(F.concat(F.lit(f"{n} does not parse: "), "value"))

    def parsed(i, field):
        text = F.trim(F.get("f", F.lit(i)))
        return F.coalesce(text.try_cast(field.dataType), bad(field.name).cast(field.dataType)).alias(field.name)

    out = cells.select(*[parsed(i, field) for i, field in enumerate(MANIFEST.fields)])
    if not body.limit(1).count():
        raise ValueError("the manifest has no rows")
    return out


def append_trials(trials, path):
    """Add trial rows to a manifest folder; rows that are there stay as they are."""
    trials.select(*MANIFEST.names).write.mode("append").option("header", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def save_gain_match(spark, gains, corrections, path, full_scale=FULL_SCALE):
    doc = ("relative_gain_match", {str(k): float(v) for k, v in gains.items()}, {str(k): float(v) for k, v in corrections.items()}, full_scale)
    spark.createDataFrame([doc], GAIN_MATCH).coalesce(1).write.mode("overwrite").json(path)


def load_gain_match(spark, path):
    """Corrections by channel number and the full scale; another kind of document is refused."""
    doc = spark.read.schema(GAIN_MATCH).json(path).first()
    if doc["kind"] != "relative_gain_match":
        raise ValueError(f"not a gain match: {doc['kind']!r}")
    return {int(k): v for k, v in doc["corrections"].items()}, doc["full_scale"] or FULL_SCALE


def save_calibration(fits, path):
    fits.select(*[F.col(f.name).cast(f.dataType) for f in CALIBRATION.fields]).coalesce(1).write.mode("overwrite").json(path)


def load_calibration(spark, path):
    return {r["sensor"]: r.asDict() for r in spark.read.schema(CALIBRATION).json(path).collect()}  # six rows


def session_catalog(paths):
    """paths(path) with label, set number, and sensor, trial or grams of calibration files; test captures are left out."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.csv)?$", 1)
    rows = paths.withColumn("name", name).filter(~F.col("name").rlike(r"(_01$|^check_all)"))
    number = lambda p: F.regexp_extract("name", p, 1).try_cast("int")
    return rows.select(
        "path", "name", F.nullif(F.regexp_extract("name", r"^([a-z]+)_\d+$", 1), F.lit("")).alias("label"),
        number(r"^[a-z]+_(\d+)$").alias("set_no"), number(r"^cal_s(\d+)_").alias("sensor"), number(r"^cal_s\d+_t(\d+)$").alias("trial"),
        number(r"^cal_s\d+_(\d+)g$").alias("grams"),
    )


def next_trial(paths):
    """The number of the next trial per sensor."""
    return session_catalog(paths).filter("trial is not null").groupBy("sensor").agg((F.max("trial") + 1).alias("next_trial"))


#: Files up to this size are read as one value by Spark; larger ones in pieces of PIECE bytes inside a task.
WHOLE, PIECE = 64 << 20, 8 << 20


def fingerprint(spark, path, whole=WHOLE, piece=PIECE):
    """SHA-256 of each input file, of any size, by name.

    A digest is one ordered pass, so a file is one task's; a task holds a value of ``whole`` bytes or one piece of a larger file.
    Spark's file sources do not list empty files, so those have no row.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    files = lambda: spark.read.format("binaryFile").load(path)
    small = files().filter(F.col("length") <= whole).select(name, F.sha2("content", 256).alias("sha256"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        from strideforge.sources.streams import _store

        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                store, place = _store(p)
                digest = hashlib.sha256()
                with store.open_input_stream(place) as f:
                    while data := f.read(piece):
                        digest.update(data)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], ["path", "sha256"])

    paths = files().filter(F.col("length") > whole).select("path").repartition("path")  # names only: no content is read
    return small.unionByName(paths.mapInArrow(run, "path string, sha256 string").select(name, "sha256"))
