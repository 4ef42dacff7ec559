import random

import corpus_pipeline


def test_stages_and_run(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(3000)}"
    item = " ".join(word() for _ in range(30)) + "?\n" + " ".join(word() for _ in range(8))
    good = [" ".join(word() for _ in range(120)) for _ in range(60)]
    bad = ["spam!! " * 60 for _ in range(30)]
    passage = ". ".join(" ".join(word() for _ in range(8)) for _ in range(30)) + ".\n"
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t + f" {i}") for i, t in enumerate(bad)]
    rows += [(200, good[0] + " tail"), (201, good[1] + " " + item), (202, good[2][:300] + "\n" + passage), (203, good[3][:300] + "\n" + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
        d = spark.createDataFrame(d.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in d.collect()}
    assert set(kept["quality"]) == {i for i, _ in rows if not 100 <= i < 200}
    assert len(kept["line_dedup"][203]) < len(kept["line_dedup"][202])
    assert set(kept["near_duplicates"]) & {0, 200} == {0}
    assert 201 not in kept["decontaminate"] and set(range(60)) <= set(kept["decontaminate"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept["decontaminate"]) and all(r.n_tokens == len(r.ids) for r in out)
