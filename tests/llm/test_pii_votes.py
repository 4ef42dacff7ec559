"""Base spans against the plain patterns, the votes' reliabilities against known ones, added spans against planted forms."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import Row

from strideforge.llm import pii_votes as pv


def plain(text):
    """The base spans by the contract's own patterns."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = re.sub("[ -]", "", m[0])
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(n)))
        if 14 <= len(n) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


AWKWARD = [
    "", "@", "a@", "@b.c", "a@b", "a@b.", "a@b.c@d.e.f", "a.b@c..d.e", "x@y.z,w@v.u", "é@b.co", "a@é.co", "1.2.3.4.5.6.7.8", "..1.2.3.4", "1.2.3.256", "0000000000000000001.2.3.4", "1..2.3.4 9.9.9.9.9", "1.2.3.4@5.6.7",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111 1111 1111", "41111111111111112222222", "+1 (234) 567-8901", "+12345678901234567", "++1 234 567 8901", "+1 234 567 8901 ", "+1-2", "+4111 1111 1111 1111", "+٣ 123 456 7890", "1.2.3.4" * 5, "x" * 300 + "@" * 3, "a@b.c-", "-@-.-",
]


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    texts = AWKWARD + ["".join(rng.choice("aA0159@@..-- +()%_é\n") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789 -+.") for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t in texts:
        assert pv.base_spans(t) == plain(t), t


def test_hostile_texts_take_linear_time():
    makers = [
        lambda n: "a" * n, lambda n: "1" * n, lambda n: "1.1" * (n // 3), lambda n: "+1 " * (n // 3), lambda n: "(" * n, lambda n: "1 " * (n // 2) + "x", lambda n: "a@" * (n // 2), lambda n: "AB12CDEF" * (n // 8), lambda n: "a:" * (n // 2),
        lambda n: "aa-bb-" * (n // 6), lambda n: "x dot y " * (n // 8), lambda n: "Mr " * (n // 3), lambda n: "12 Main Old " * (n // 12), lambda n: "Ab 1 " * (n // 5), lambda n: "A" * n, lambda n: "a(at)" * (n // 5),
    ]
    for make in makers:
        took = []
        for n in (20_000, 160_000):
            text = make(n)
            began = time.process_time()
            pv.candidates(text, pv.base_spans(text))
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.3, (make(12), took)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    true = np.array([[0.95, 0.1], [0.8, 0.3], [0.9, 0.05], [0.6, 0.4], [0.85, 0.2]])
    y = rng.random(30_000) < 0.3
    counts = {}
    for t in y:
        v = ["+" if rng.random() < p else "-" for p in true[:, 0 if t else 1]]
        v[rng.integers(5)] = "0"
        k = ("phone", "".join(v))
        counts[k] = counts.get(k, 0) + 1
    share, odds, posterior = pv.reliabilities(counts)
    assert abs(share["phone"] - 0.3) < 0.02
    assert np.abs(odds - true).max() < 0.04
    assert posterior["phone", "+++0+"] > 0.97 and posterior["phone", "---0-"] < 0.03


#: Written forms of each kind (what a person would write, not what the module's patterns say), and look-alikes.
FORMS = {
    "phone": ["(212) 664-7665", "415-555-2671", "030 1234 5678", "01 42 68 53 00", "0044 20 7946 0958"],
    "email": ["jane.doe [at] mail [dot] org", "max (at) firma (dot) de", "info at verein dot org", "k.lee{at}uni.edu"],
    "ssn": ["219-09-9999", "078-05-1120"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606", "NL91ABNA0417164300"],
    "ipv6": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a"],
    "mac": ["00:1B:44:11:3A:B7", "a4-5e-60-c2-19-0f"],
    "person": ["Mr. John Smith", "Frau Petra Schneider", "my name is Laura Bianchi", "Señor Carlos Ruiz", "Dr. Alice Walker"],
    "address": ["221 Baker Street", "1600 Pennsylvania Avenue", "Hauptstraße 12", "12, rue de Rivoli", "Calle Mayor 15"],
    "birth": ["born 12/05/1984", "geboren 03.11.1975", "dob 1990-07-21"],
}
CUE = {"phone": "please call", "email": "write to", "ssn": "social security number", "iban": "account", "ipv6": "server address", "mac": "device", "person": "with", "address": "lives at", "birth": "she was"}
ALIKE = [
    "version 10.2.3", "isbn 978-3-16-148410-0", "pages 112-119-120", "order 4929-1023-7777-0001", "part 55-12-3456", "updated 2021-13-45", "ratio 3.14159265", "1 2 3 4 5 6 7 8 9", "ticket 123-456-789", "batch 2020/10/10", "scores 10 12 14 16 18 20", "total 1234.56 7890.12",
    "id 1234567890123456", "look at page two", "at noon dot", "Old Market is busy", "New York Times", "The House", "see 12 Old Books", "AB12 is full", "ten:to:one", "std::vector<int>", "10-20-30-40", "12:30:45:10",
]


def prose(rng, n):
    return [rng.choice("the reader of this small story went over a long road and came back with many new words for every day".split()) for _ in range(n)]


def planted(seed, n):
    rng, rows, truth = random.Random(seed), [], {}
    base = ["anna@mail.org", "10.20.30.40", "4111 1111 1111 1111", "+49 30 1234567", "bob.r@firm.de", "5500005555555559", "+1 (212) 555-0187", "172.16.254.3"]
    for i in range(n):
        text, spans = " ".join(prose(rng, rng.randrange(20, 90))), []
        for _ in range(rng.randrange(4)):
            kind = rng.choice([*FORMS, "base", "base", "alike", "alike", "alike"])
            words = " ".join(prose(rng, rng.randrange(3, 20)))
            value = rng.choice(base if kind == "base" else ALIKE if kind == "alike" else FORMS[kind])
            text += f" {CUE.get(kind, 'and') if rng.random() < 0.8 else 'and'} "
            if kind in FORMS:
                core = re.sub(r"^(?:Mr\. |Dr\. |Frau |Señor |my name is |born |geboren |dob )", "", value)
                spans.append((kind, len(text) + value.index(core), len(text) + value.index(core) + len(core)))
            text += f"{value} {words}"
        rows.append((i, text + "."))
        truth[i] = spans
    return rows, truth


def test_added_spans_find_planted_forms(spark):
    rows, truth = planted(1, 900)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pv.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, wanted, hit, false = dict(rows), {}, {}, []
    for i, spans in got.items():
        base = {(pv.BASE[k], a, b) for a, k, b in plain(texts[i])}
        assert base <= set(spans)
        added = [s for s in spans if s not in base]
        for k, a, b in truth[i]:
            wanted[k] = wanted.get(k, 0) + 1
            hit[k] = hit.get(k, 0) + any(x == k and c < b and a < d for x, c, d in spans)
        false += [(k, texts[i][a:b]) for k, a, b in added if not any(c < b and a < d for _, c, d in truth[i])]
    total, found = sum(wanted.values()), sum(hit.values())
    print({k: (hit[k], wanted[k]) for k in wanted}, false[:20])
    assert found >= 0.85 * total
    assert len(false) <= 0.03 * found


def test_nothing_is_added_to_plain_documents(spark):
    """The given table holds personal data of the base kinds only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pv.scan(docs.select("doc_id", "text")).collect()
    assert [s for r in rows for s in r.spans if (s.start, s.end, s.kind) not in {(x.start, x.end, x.kind) for x in r.seen if x.base}] == []
    assert sum(len(r.spans) for r in rows) > 20


def test_query_and_edges(spark, tmp_path):
    texts = [None, "", " ", *AWKWARD, "mail a@b.co then 1.2.3.4 and +1 (234) 567-8901 end", "x" * 200_000 + " a@b.co"]
    rows = [Row(doc_id=i, text=t, spans=1, seen="x") for i, t in enumerate(texts)] + [Row(doc_id=None, text="a@b.co", spans=1, seen="x")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, spans int, seen string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pv.op12_pii_votes(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        base = plain((texts[r.doc_id] if r.doc_id is not None else "a@b.co") or "")
        text = ",".join(f"{pv.BASE[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pv.scan(empty).count() == 0
    assert pv.scan(spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")).first().spans == []
