import random

import pytest

from strideforge.llm import secret_crf

B62 = secret_crf.LOWER + secret_crf.UPPER + secret_crf.DIGITS


def prose(rnd, n):
    syllables = "an the re ing ed or in st ea ti on lo mi de ka su".split()
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n)]
    for _ in range(n // 15):
        words[rnd.randrange(n)] = rnd.choice(["a@b.org", "2024-01-02", "https://x.example/page-1.html", "v1.2.3", "+49 170 1234567", "***", "KEY_NAME", "snake_case_name"])
    return words


def unseen(rnd):
    """Forms that the training examples do not hold."""
    r = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    return rnd.choice([
        f"aws_access = {r(B62 + '+/', 40)}", f"eyJ{r(B62, 17)}.eyJ{r(B62 + '_-', 60)}.{r(B62 + '_-', 43)}", f"ghp_{r(B62, 36)}",
        f"postgresql://app:{r(B62 + '!', 12)}@db.internal:5432/app", f"pwd = '{r(B62 + '!#', 12)}'", f"xoxb-{r(secret_crf.DIGITS, 11)}-{r(B62, 24)}",
    ])


@pytest.fixture(scope="module")
def weights(spark):
    rnd = random.Random(1)
    texts = []
    for i in range(500):
        w = prose(rnd, 120)
        if i % 5 == 0:
            w[rnd.randrange(120)] = f'password="{"".join(rnd.choice(B62) for _ in range(12))}"'
        texts.append(" ".join(w))
    return secret_crf.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_the_field_adds_unseen_forms(spark, weights):
    rnd, rows, where = random.Random(2), [], {}
    for i in range(300):
        w = prose(rnd, 150)
        if i % 2:
            at = rnd.randrange(len(w))
            w.insert(at, unseen(rnd))
            start = len(" ".join([*w[:at], ""]))
            where[i] = (start, start + len(w[at]))
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.spans for r in secret_crf.scan(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()}
    added = [(i, s["start"], s["end"]) for i, spans in got.items() for s in spans if s["kind"] == "crf"]
    right = [(i, a, b) for i, a, b in added if i in where and where[i][0] <= a and b <= where[i][1]]
    found = {i for i, _, _ in right} | {i for i, spans in got.items() if i in where and any(s["kind"] != "crf" and where[i][0] <= s["start"] < where[i][1] for s in spans)}
    assert len(found) >= 0.93 * len(where) and len(right) >= 0.95 * len(added) and len({i for i, _, _ in right}) > 0.8 * len(where)
    text = dict(rows)
    assert all(not set(text[i][a] + text[i][b - 1]) & set("\"',") for i, a, b in added)


GIVEN = "/root/testdata/sf0.01/documents.parquet"


def public_formats(rnd):
    """Published forms of keys and tokens, none of which the training examples are made of."""
    r = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    up, low, num, hexa = secret_crf.UPPER, secret_crf.LOWER, secret_crf.DIGITS, "0123456789abcdef"
    return [
        f"sk_live_{r(B62, 24)}", f"AIza{r(B62 + '_-', 35)}", f"https://hooks.slack.com/services/T{r(up + num, 8)}/B{r(up + num, 8)}/{r(B62, 24)}", f"glpat-{r(B62 + '_-', 20)}", f"npm_{r(B62, 36)}",
        f"SG.{r(B62 + '_-', 22)}.{r(B62 + '_-', 43)}", f"github_pat_{r(B62, 22)}_{r(B62, 59)}", f"AccountKey={r(B62 + '+/', 86)}==", f"ya29.{r(B62 + '_-', 60)}", f"dop_v1_{r(low + num, 64)}",
        f"amqps://svc:{r(B62 + '$!', 16)}@mq.internal:5671/prod", f"hf_{r(B62, 34)}", f"xoxp-{r(num, 12)}-{r(num, 12)}-{r(hexa, 32)}", f"shpat_{r(hexa, 32)}", f"eyJ{r(B62, 33)}.eyJ{r(B62 + '_-', 90)}.{r(B62 + '_-', 86)}",
    ]


def test_whole_documents_of_the_given_table(spark):
    """The table holds base kinds only: nothing is added to it. Public formats planted in its whole documents are found."""
    docs = [r for r in spark.read.parquet(GIVEN).select("doc_id", "text").orderBy("doc_id").collect() if r.text]
    weights = secret_crf.train(spark.read.parquet(GIVEN))
    plain = secret_crf.scan(spark.read.parquet(GIVEN), weights).collect()
    assert [(r.doc_id, s) for r in plain for s in r.spans if s["kind"] == "crf"] == []
    rnd, rows, where = random.Random(7), [], {}
    for k, d in enumerate(docs):
        words = d.text.split(" ")
        if k % 4 == 0:
            at = rnd.randrange(len(words) + 1)
            forms = public_formats(rnd)
            words.insert(at, forms[k // 4 % len(forms)])
            start = len(" ".join([*words[:at], ""])) if at else 0
            where[d.doc_id] = (start, start + len(words[at]))
        rows.append((d.doc_id, " ".join(words)))
    got = {r.doc_id: r.spans for r in secret_crf.scan(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()}
    hit = sum(any(s["start"] < where[i][1] and where[i][0] < s["end"] for s in got[i]) for i in where)
    false = [(i, s) for i, spans in got.items() for s in spans if s["kind"] == "crf" and not (i in where and s["start"] < where[i][1] and where[i][0] < s["end"])]
    print("recall", hit, len(where), "false", [(dict(rows)[i][s["start"] : s["end"]]) for i, s in false])
    assert hit >= 0.9 * len(where) and len(false) <= 0.02 * hit
    assert [i for i, _ in false if i not in where] == []  # nothing in a document without a planted secret


def test_base_spans_stay_and_edges(spark, weights):
    word = "abcdefghij" * 30_000
    rows = [(1, 'x secret="zzzzzzzz" y'), (2, None), (3, ""), (None, "token: abcdefgh"), (4, f"{word} {'0123456789abcdef' * 2} tail"), (1, 'x secret="zzzzzzzz" y')]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, [(s["start"], secret_crf.KINDS.index(s["kind"]), s["end"]) for s in r.spans if s["kind"] in secret_crf.KINDS]) for r in secret_crf.scan(df, weights).collect()]
    assert sorted(got, key=str) == sorted([(i, secret_crf.base_spans(t or "")) for i, t in rows], key=str)
    assert all(not any(a["start"] < b["end"] and b["start"] < a["end"] for a in r.spans for b in r.spans if a["kind"] == "crf" and a != b) for r in secret_crf.scan(df, weights).collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secret_crf.train(empty) is None and secret_crf.scan(empty).count() == 0
