"""The interval parser against an exhaustive search and against all cuts; the query against plain Python; spread conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import duckdb

from strideforge.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")


def edits_of(code, last):
    """(edit, letter that stays, cost) of one row's code."""
    yield "D", "", 4
    if code != "x":
        extra = 3 if code.isupper() else 0
        if code.lower() in "sua":
            yield "K", code.lower(), extra
        yield "R", "u", 3 + extra
        yield "R", "a", 3 + extra


def exhaustive(codes):
    """Every choice of edits with up to two rows inserted at each place."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*[list(edits_of(c, "")) for c in codes]):
        for ins in itertools.product(inserts, repeat=len(codes) + 1):
            letters = ins[0] + "".join(e[1] + i for e, i in zip(choice, ins[1:]))
            if LEGAL.fullmatch(letters):
                cost = sum(e[2] for e in choice) + 3 * sum(map(len, ins))
                audit = "I" * len(ins[0]) + "".join(e[0] + "I" * len(i) for e, i in zip(choice, ins[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def by_suffixes(codes):
    """The least (cost, audit) by the automaton of legal roles: begin, after s, after u, after a."""
    step = {("b", "s"): "s", ("b", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def rest(i, state, inserted):
        found = [(0, "")] if i == len(codes) and state in "ba" else []
        options = [("I", x, 3, i, inserted + 1) for x in "ua"] if inserted < 3 else []
        if i < len(codes):
            options += [(e, x, c, i + 1, 0) for e, x, c in edits_of(codes[i], "")]
        for e, x, c, j, k in options:
            to = step.get((state, x)) if x else state
            if to and (tail := rest(j, to, k)):
                found.append((c + tail[0], e + tail[1]))
        return min(found, default=None)

    return rest(0, "b", 0)


def all_cuts(codes):
    """CYK over all spans and all cuts."""
    n = len(codes)
    cells = {(i, i + 1): cr.LEAVES[c] for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = {}
            for k in range(i + 1, i + length):
                for kind, v in cr.joined(cells[i, k], cells[k, i + length]).items():
                    cell[kind] = min(v, cell.get(kind, v))
            cells[i, i + length] = cr.closed(cell)
    return cells[0, n] if n else cr.EMPTY


def test_exhaustive():
    for n in range(3):
        for codes in itertools.product("xuasoUASO", repeat=n):
            assert cr.best(cr.parse(codes)) == exhaustive(codes) == by_suffixes(codes), codes
    rng = random.Random(1)
    for _ in range(12):
        codes = "".join(rng.choice("xuasoUASO") for _ in range(3))
        assert cr.best(cr.parse(codes)) == exhaustive(codes) == by_suffixes(codes), codes


def test_one_cut_of_a_span_gives_what_all_cuts_give():
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(rng.choice(rng.choice(["xuasoUASO", "ua", "uaUAx"])) for _ in range(rng.randrange(1, 13)))
        assert cr.parse(codes) == all_cuts(codes), codes
        assert cr.best(cr.parse(codes)) == by_suffixes(codes), codes


def test_audits_of_a_cell_are_no_prefixes():
    """Strings of equal cost over a span: the least of a joined span is made of least ones."""
    for codes in itertools.product("xuaU", repeat=2):
        texts = [a for c, a in cr.parse(codes).values()]
        assert all(len(a) - a.count("I") == 2 for a in texts)


def plain(rows):
    """The query in plain Python: {conv_id: result tuple}."""
    after = {}
    blank = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kept = after.setdefault(conv, [])
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        kept += [(turn is not None, turn or 0, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, kept in after.items():
        kept.sort()
        seen, codes, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        turns = {t for there, t, _, _ in kept if there}
        cost, audit = by_suffixes(codes)
        lines, i, state = [], 0, ""
        for e in audit:
            if e == "D":
                i += 1
                continue
            role = "assistant" if state == "u" else "user"
            if e == "K":
                role = kept[i][2]
            lines.append(f"{role}:{'' if e == 'I' else kept[i][3]}")
            i += e != "I"
            state = role[:1]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
DDL = "conv_id long, turn long, role string, text string, n int, part long"


def made_up(rng):
    texts = ["Yes.", "no", " \t", "", None, "What?\x0b ", "go on!", "a" * 40, "zu\u0085"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "unknown"]
    rows = []
    for conv in [*range(120), None, -7]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            turn = rng.choice([turn, turn, turn, turn + 4, None])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows + rows[:9]


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(3)
    rows = made_up(rng)
    rows += [(500, t, rng.choice(["user", "assistant"]), rng.choice(["Well.", "so", f"{t}.", f"{t % 50}!"])) for t in range(150)]
    spark.createDataFrame([(*r, 7, 1) for r in rows], DDL).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(rows)
    twin = duckdb.sql(cr.TWIN.replace("from conversations", f"from '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert {r[0]: r[1:] for r in twin} == want
    for size in (4096, 3, 1):
        got = cr.op13_conversation_repair(spark, str(tmp_path), fragment_rows=size)
        assert got.columns == ["conv_id", *NAMES] and {t for _, t in got.dtypes} == {"bigint", "string"}
        got = got.collect()
        assert len(got) == len(want)
        for r in got:
            assert tuple(r[c] for c in NAMES) == want[r.conv_id], (size, r)


def test_operator_gives_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (2, 0, "assistant", "So.")]
    reports, pieces = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in reports.collect()}
    assert (found[1].cost, found[1].audit) == (7, "KDR") and (found[2].cost, found[2].audit) == (3, "IK")
    messages = {r.conv_id: [tuple(m) for m in r.messages] for r in pieces.collect()}
    assert messages == {1: [("user", "Hi.", "K"), ("assistant", "Well?", "R")], 2: [("user", "", "I"), ("assistant", "So.", "K")]}


def test_empty_table_and_conversation_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(none)[0].count() == 0
    gone = spark.createDataFrame([(4, 1, "user", "x.", 0)], "conv_id long, turn long, role string, text string, times int")
    reports, pieces = cr.repair(gone, "times")
    assert [tuple(r) for r in reports.collect()] == [(4, 0, 0, 0, 0, 0, 0, "")]
    assert [r.messages for r in pieces.collect()] == [[]]
