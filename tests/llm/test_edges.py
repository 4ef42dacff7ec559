"""Every operator on empty tables, nulls, empty and very long texts, repeated rows and columns of clashing names; and brute force where SQL is none."""

import itertools
import math
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from strideforge.llm import bm25_leaks, byte_bpe, html_text, license_align, line_dedup, minhash, quality_ftrl
from strideforge.llm.common import mix64

DOCS = "doc_id long, text string, score double, ids array<int>, spans string, n_removed int, _id string, label int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, [1], "s", 2, "x", 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "no id here"), (None, None), (4, LONG), (5, LONG), (6, "\x00\x01\x01s � 😀 " * 3)]).cache()


def test_quality(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 40)], "doc_id long, quality int, score int")
    w = quality_ftrl.train(odd, labels)
    got = quality_ftrl.score(odd, w)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"] and got.count() == 9
    same = quality_ftrl.score(odd, w, name="quality")
    assert same.columns == [*odd.columns, "quality"]
    by = {}
    for r in same.collect():
        by.setdefault(r.text or "", set()).add(r.quality)
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in by.values())
    none = odd.limit(0)
    assert quality_ftrl.train(none, labels) is None and quality_ftrl.score(none, w).count() == 0


def test_features_and_scores_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["Abc", "abc", "A1", "x!!", "q-7", "é"]) for _ in range(n)) for n in (0, 1, 2, 9, 40)]
    bits = 12
    m = lambda v: int(mix64(np.array([v % 2**64], np.uint64))[0])

    def own(text):
        words, out = text.split(), []
        for k, w in enumerate(words):
            shape = "".join(c for c, _ in itertools.groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
            pair = [xxhash.xxh3_64_intdigest(w, 1), m(xxhash.xxh3_64_intdigest(shape, 2) + (k > 0 and words[k - 1] == w))]
            for j, v in enumerate(pair):
                p = 0
                if k:
                    b = words[k - 1]
                    bs = "".join(c for c, _ in itertools.groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in b))
                    p = [xxhash.xxh3_64_intdigest(b, 1), m(xxhash.xxh3_64_intdigest(bs, 2) + (k > 1 and words[k - 2] == b))][j]
                out += [m(v) >> (64 - bits), m(p * 0x9E3779B97F4A7C15 + v + 7) >> (64 - bits)]
        return out

    f, offsets = quality_ftrl.features(pa.array(texts), bits)
    assert [sorted(f[a:b].tolist()) for a, b in zip(offsets, offsets[1:])] == [sorted(own(t)) for t in texts]
    w = np.random.default_rng(1).normal(size=2**bits + 1).astype(np.float32)
    got = [r.score for r in quality_ftrl.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), w, bits).orderBy("doc_id").collect()]
    want = [1 / (1 + math.exp(-(sum(float(w[k]) for k in own(t)) * 4 * quality_ftrl.SCALE / max(1, 4 * len(t.split())) + float(w[-1])))) for t in texts]
    assert np.allclose(got, want, atol=1e-5)


def test_updates_equal_scalar_ftrl():
    rng = np.random.default_rng(2)
    n, bits = 60, 5
    rows = [(float(rng.integers(2)), np.sort(rng.choice(32, rng.integers(1, 6), replace=False)), rng.random(6)) for _ in range(n)]
    z, s = np.zeros(33), np.zeros(33)

    def weight(i):
        if abs(z[i]) <= quality_ftrl.L1:
            return 0.0
        return -(z[i] - math.copysign(quality_ftrl.L1, z[i])) / ((quality_ftrl.BETA + math.sqrt(s[i])) / quality_ftrl.ALPHA + quality_ftrl.L2)

    for epoch in range(2):
        for r in np.random.default_rng(epoch).permutation(n):
            y, f, v = rows[r]
            x = {**{int(k): float(u) for k, u in zip(f, v)}, 32: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * u for i, u in x.items())))
            for i, u in x.items():
                g = (p - y) * u
                z[i] += g - (math.sqrt(s[i] + g * g) - math.sqrt(s[i])) / quality_ftrl.ALPHA * w[i]
                s[i] += g * g
    sizes = [len(f) for _, f, _ in rows]
    mine = quality_ftrl.fit(np.array([y for y, _, _ in rows]), np.concatenate([f for _, f, _ in rows]), np.concatenate([v[:k] for (_, _, v), k in zip(rows, sizes)]), np.concatenate([[0], np.cumsum(sizes)]), bits, 2)
    assert np.allclose(mine, [weight(i) for i in range(33)], atol=1e-6)


def test_line_dedup(odd):
    for out in (line_dedup.remove_repeats(odd), line_dedup.remove_passages(odd, copies=0.5)):
        assert out.columns == [c for c in odd.columns if c != "n_removed"] + ["n_removed"] and out.count() == 9
        assert sum(len(r.text) for r in out.collect()) <= 2 * len(LONG) + 100
    assert line_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_near_duplicates(odd):
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert [i for i, _ in got] == ["1", "2", "3", "4", "6", "None", "None"]


def test_leaks(spark, odd):
    items = spark.createDataFrame([(1, "word5 word6 word7 word8 word9 word10\nword11 word12 word13 word14 word15", 1), (2, None, 1), (3, "", 1), (None, "no id here", 1), (4, "No id, here!", 1)], "item_id long, text string, doc_id int")
    got = sorted((str(r.doc_id), r.item_id) for r in bm25_leaks.leaks(odd, items).collect())
    assert got == [("4", 1), ("5", 1), ("None", 4)]
    assert bm25_leaks.leaks(odd.limit(0), items).count() == 0


def test_bpe(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.round_trip(odd.drop("ids")).collect()
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.load_ranks(path)) if t}, special_tokens={})
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert byte_bpe.round_trip(odd.limit(0).drop("ids")).count() == 0


def test_licenses(spark, odd):
    both = odd.unionByName(docs(spark, [(9, LONG + " Released under the MIT License. " + LONG), (None, "Licensed under CC BY-NC 4.0."), (10, "x" * 2_000_000)]))
    assert sorted((str(r.doc_id), r.license) for r in license_align.scan(both).collect()) == [("9", "MIT-notice"), ("None", "CC-BY-NC-4.0-short")]
    assert license_align.scan(odd.limit(0)).count() == 0


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def plain_patience(a, b, lo=0, lo2=0):
    """Patience alignment by recursion over lists, the longest increasing run by trying all ends."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(lo, lo2), *plain_patience(a[1:], b[1:], lo + 1, lo2 + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], lo, lo2), (lo + len(a) - 1, lo2 + len(b) - 1)]
    once = [(a.index(w), b.index(w)) for w in set(a) if a.count(w) == 1 and b.count(w) == 1]
    once.sort()
    best = []
    for k, (_, j) in enumerate(once):
        best.append(max([best[h] for h in range(k) if once[h][1] < j], key=len, default=[]) + [k])
    if not best:
        return []
    chain = [once[k] for k in max(best, key=len)]
    out, p, q = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += plain_patience(a[p:i], b[q:j], lo + p, lo2 + q)
        if i < len(a):
            out.append((lo + i, lo2 + j))
        p, q = i + 1, j + 1
    return out


def test_patience_equals_a_plain_version():
    rnd = random.Random(11)
    for _ in range(300):
        a, b = ([rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(14))] for _ in range(2))
        got, want = license_align.patience(a, b), plain_patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= lcs(a, b)
        if len({len(x) for x in (got, want)}) > 1:  # of equally long chains of anchors either may be taken
            assert abs(len(got) - len(want)) <= 3


def test_license_spans_equal_a_scan_of_all_places(spark):
    rnd = random.Random(5)
    names = [k for k in license_align.TEMPLATES if len(license_align.words_of(license_align.TEMPLATES[k])) < 40]
    texts, where = [], {}
    for i in range(120):
        w = [f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(60))]
        if i % 2:
            name = rnd.choice(names)
            at = rnd.randrange(len(w) + 1)
            part = license_align.TEMPLATES[name].split()
            where[i] = (name, len(license_align.words_of(" ".join(w[:at]))), len(license_align.words_of(" ".join(part))))
            w[at:at] = part
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r for r in license_align.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got.keys() == where.keys()
    for i, (name, first, n) in where.items():
        assert (got[i].first_word, got[i].last_word) == (first, first + n - 1) and got[i].coverage == 1.0


def test_pages(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>" + LONG, "t"), (2, "u", "<div>" * 50_000 + "end", "t")]
    got = {r.page_id: r.n_chars for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {1: 0, None: len(LONG), 2: 3}


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline(spark, tmp_path, empty):
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(80)), "en", "s", 1, 0.5, 7) for i in range(40)]
    rows += [(50 + i, "spam!! " * 50, "en", "s", 1, 0.5, 7) for i in range(20)]
    rows += [(None, rows[0][1] + " more", None, None, None, None, None), (None, item, None, None, None, None, None), (7, rows[7][1], "en", "s", 1, 0.5, 7), (8, "other text of the same id " * 3, "en", "s", 1, 0.5, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed int")
    table = table.limit(0) if empty else table
    base = f"{tmp_path}/d"
    table.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    d = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, base)
        assert d.columns == table.columns
    got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, base).collect())
    if empty:
        assert got == []
    else:
        assert got == sorted([str(i) for i in range(40)] + ["8"])  # one row of 7, both texts of 8; no leak and no copy without an id
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000" and F is not None
