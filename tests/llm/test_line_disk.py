import random
import time

from pyspark.sql import functions as F

from strideforge.llm import line_dedup
from strideforge.llm.common import materialize, parted


def corpus(n, repeated):
    """n texts of which each ``repeated``-th holds the same passage."""
    rnd = random.Random(9)
    line = lambda: " ".join(f"w{rnd.randrange(90000)}" for _ in range(9)) + ". "
    passage = "".join(line() for _ in range(20))
    return [(i, "".join(line() for _ in range(20)) + (passage if i % repeated == 0 else "")) for i in range(n)]


def shuffled(spark, df):
    """Bytes that df's execution writes to its exchanges, written tables not included."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name == "Exchange":
            found += p.metrics().apply("shuffleBytesWritten").value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_texts_without_repeats_are_not_shuffled(spark):
    docs = corpus(3000, 60)
    size = sum(len(t) for _, t in docs)
    df = materialize(spark.createDataFrame(docs, "doc_id long, text string"), "line-disk-docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        for operator in (line_dedup.remove_repeats, line_dedup.remove_passages):
            out = operator(df)
            assert shuffled(spark, out) < size / 5
            got = {r.doc_id: r for r in out.collect()}
            assert len(got) == 3000 and all(got[i].text == t and got[i].n_removed == 0 for i, t in docs if i % 60)
            assert all(got[i].n_removed > 0 for i in range(60, 3000, 60))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_that_can_meet_a_key(spark):
    rows = spark.range(5000).select((F.col("id") - 2500).alias("_id"), F.xxhash64("id").alias("_th"), F.col("id").alias("_bit"))
    for of in (1, 7, 5001):
        keys = materialize(rows.filter(F.pmod("_bit", F.lit(of)) == of - 1).select("_id", "_th"), "line-disk-keys")
        some, none = parted(rows, keys)
        a, b = {tuple(r) for r in some.collect()}, {tuple(r) for r in none.collect()}
        wanted = {tuple(r) for r in keys.collect()}
        assert some.columns == none.columns == rows.columns and not a & b and len(a) + len(b) == 5000
        assert wanted <= {r[:2] for r in a} and len(a) - len(wanted) < 5000 / 8


def test_shuffle_files_go_with_their_step(spark):
    def files():
        local = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {local.apply(k).getName() for k in range(local.size()) if local.apply(k).getName().startswith("shuffle_")}

    df = spark.createDataFrame(corpus(200, 2), "doc_id long, text string").repartition(4, "doc_id")
    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    line_dedup.materialize(df, "line-disk-written")
    assert spark.conf.get(key) == kept
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    materialize(df, "line-disk-kept")
    assert files() - before
