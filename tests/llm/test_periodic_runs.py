"""Runs against a brute force over all stretches, the planted query against plain Python, and edge cases."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strideforge.llm import periodic_runs as pr


def brute(words, exponent=4, least=6):
    """All maximal stretches of every period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 4), (5, 9), (2, 8)])
def test_runs_equal_brute_force(exponent, least):
    rng = random.Random(exponent * 10 + least)
    for trial in range(250):
        n, kinds = rng.randrange(0, 160), rng.choice([1, 2, 2, 3, 5, 50])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n:
                a, p = rng.randrange(n), rng.randrange(1, 25)
                for i in range(a + p, min(n, a + p * rng.randrange(2, 9) + rng.randrange(p))):
                    words[i] = words[i - p]
        assert pr.runs_of(words, exponent, least) == brute(words, exponent, least), words


def test_spared_words_change_nothing():
    import numpy as np

    rng = random.Random(5)
    texts = [[rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(60))] for _ in range(300)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ends = pr.copies_end(np.array([w for t in texts for w in t], np.int64), offsets)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert pr.runs_of(t, ends=ends[a:b].tolist()) == brute(t)


def test_squares_are_reported_as_words_come():
    catcher, seen = pr.SquareCatcher(2, 2), []
    words = [7, 1, 2, 3, 1, 2, 3, 1, 9]
    for i, w in enumerate(words):
        seen.append((i, catcher.append(w)))
    assert [i for i, s in seen if (1, 3) in s] == [6, 7]
    assert catcher.finish() == [(1, 7, 3)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_hostile_sequences():
    assert pr.runs_of(fibonacci(900), 2, 2) == brute(fibonacci(900), 2, 2)
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert pr.runs_of([3] * n) == [(0, n, 1)]
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1
    half = list(range(30_000))
    assert pr.runs_of(half * 5) == [(0, 150_000, 30_000)]
    assert pr.runs_of(([1] * 9 + [2]) * 40) == brute(([1] * 9 + [2]) * 40)


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if best[2] else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["der", "die", "a\u0085b", " ", "x" * 50, "été", "1", "ok."]
    texts = ["", None, " \n\t ", "one", "a a a a a", "a a a a a a", "a\x0ba\x0ca a\ra\na", "b " * 400]
    texts += [" ".join(rng.choice(vocabulary[: rng.choice([2, 8])]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [("p q r s t \n" * rng.randrange(2, 9)).strip() for _ in range(20)]
    rows = [Row(doc_id=i - 3, text=t, runs=1, collapsed=None) for i, t in enumerate(texts)] + [Row(doc_id=None, text="z " * 8, runs=2, collapsed=None), Row(doc_id=5, text="u v " * 9, runs=3, collapsed=None)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op11_square_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain(r.doc_id, r.text) for r in rows), key=key)


def test_operator_gives_texts_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "go on " * 5 + "then stop")], "doc_id long, text string")
    row = pr.find(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 10, 2)] and row.collapsed == "go on then stop"
    assert pr.find(docs, min_exponent=6).first().runs == []
    assert pr.find(docs.limit(0)).count() == 0
    assert pr.find(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))).first().collapsed == ""
