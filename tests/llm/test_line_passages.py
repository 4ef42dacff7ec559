import random

from strideforge.llm import line_dedup


def windows(text, n=50):
    words = text.split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_no_repeated_passage_is_left(spark):
    rnd = random.Random(5)
    line = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(8, 15))) + "."
    own = lambda: " ".join(line() for _ in range(rnd.randrange(1, 6)))
    passages = [rnd.choice([" ", "\n", "\n\n"]).join(line() for _ in range(rnd.randrange(6, 9))) for _ in range(40)]
    docs = [(i, f"{own()}\n{p}\n{own()}") for i, p in enumerate(passages + passages)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen, repeated = set(), 0
    for i, t in docs:
        left = windows(got[i][0])
        repeated += bool(windows(t) & seen)
        assert not left & seen
        seen |= windows(t)
        if i < 40:
            assert got[i] == (t, 0)
        else:  # what stands nowhere else stays, to the byte
            p = passages[i - 40] + "\n"
            assert got[i][0] == t.replace(p, "") and got[i][1] >= 6
    assert repeated == 40


def test_passage_rows(spark):
    schema = "doc_id long, text string, n_removed int, lang string"
    two = "a line of some length that comes first.\nand another one, just as long.\n"
    rows = [(None, two, 1, "x"), (None, two, 1, "x"), (3, "own.\n" + two, 1, "y"), (4, None, 1, "z"), (5, "no. no. no. no. ", 1, "z"), (6, "\n\n", 1, "z")]
    out = line_dedup.remove_passages(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "lang", "n_removed"]
    got = sorted((str(r.doc_id), r.text, r.lang, r.n_removed) for r in out.collect())
    # pairs of short lines that repeat inside one text come to fewer than 64 characters
    assert got == [("3", "own.\n", "y", 2), ("4", "", "z", 0), ("5", "no. no. no. no. ", "z", 0), ("6", "\n\n", "z", 0), ("None", two, "x", 0), ("None", two, "x", 0)]
    assert line_dedup.remove_passages(spark.createDataFrame([], schema)).count() == 0


def test_whole_copies_can_be_left_to_the_search_for_near_duplicates(spark):
    rnd = random.Random(12)
    sentence = lambda: " ".join(f"v{rnd.randrange(9000)}" for _ in range(9)) + ". "
    base = [sentence() for _ in range(20)]
    near = list(base)
    near[7] = near[7].replace("v", "changed", 1)
    passage = "".join(sentence() for _ in range(7))
    texts = ["".join(base), "".join(base), "".join(near), "".join(sentence() for _ in range(12)) + passage, "".join(sentence() for _ in range(12)) + passage]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int")
    got = {r.doc_id: (r.text, r.gone) for r in line_dedup.remove_passages(df, copies=line_dedup.COPY, count="gone").collect()}
    assert [got[i] for i in range(4)] == [(t, 0) for t in texts[:4]]
    assert got[4] == (texts[4][: -len(passage)], 7)
    torn = {r.doc_id: r.text for r in line_dedup.remove_passages(df).collect()}
    assert torn[1] == "" and len(torn[2]) < len(texts[2]) / 4 and torn[4] == got[4][0]


def test_lines_can_be_those_of_line_feeds_only(spark):
    two = "One sentence here. And another one, on the same line of some length.\nA second line, which is long enough too.\n"
    inline = "One sentence here. And another one, on the same line of some length. "
    rows = [(1, two + "own"), (2, "other\n" + two), (3, "x. " + inline * 2 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_passages(df, split=line_dedup.LINES).collect()}
    assert got == {1: rows[0][1], 2: "other\n", 3: rows[2][1]}
    got = {r.doc_id: r.text for r in line_dedup.remove_passages(df).collect()}
    assert got[2] == "other\n" and len(got[3]) < len(rows[2][1])
    assert line_dedup.remove_repeats(df, split=line_dedup.LINES).count() == 3
