"""Repair of conversations: the cheapest edits that give a legal order of roles, by weighted CYK interval parsing.

Rows of a conversation stand by turn (nulls first; equal turns by role, then text). A row's first fault counts: blank (no
character but white space), duplicate (role and text stood in an earlier row), truncated (the last character that is not white
space is none of ``.!?``). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows),
Insert an empty user or assistant row anywhere 3; a truncated row that stays adds 3. The repaired roles' first letters are
``(s?(ua)+)?``; of repairs with the least cost that with the least audit (the edits' initials in order) is taken.

The grammar in Chomsky normal form has a nonterminal for each kind of span: E (nothing stays), XY (alternating letters from X
to Y, for X, Y of u and a), S (an s alone), SU and SA (s, then letters from u to u or a). Its rules join neighbouring spans:
XY -> XZ WY with Z and W different, SY -> S UY, SY -> SZ WY, and E is neutral; the start is E, UA or SA. A cell holds for each
nonterminal the least (cost, audit) over its span. The insertion closure of a cell lets inserted rows stand before and after it.
Cells are combined bottom-up by span length. Every nonterminal can be cut at every place of its span (the letters on both sides
of the cut name the two parts), so each cut of a span gives the same cell: spans of 1, 2, 4, ... rows with one cut each are enough,
and a conversation takes time linear in its rows but for the copying of audits. Strings of equal cost over one span are never
prefixes of each other (more letters would be insertions, which cost), so the least audit of a span is made of least audits.

Hot conversations: rows are sorted over all partitions by (conversation, turn, role, text), so a conversation of any size is spread
over tasks, in fragments of at most ``FRAGMENT_ROWS`` rows or about ``FRAGMENT_CHARS`` characters. Conversations inside one partition
are solved there. Of the others, fragments give their cells, which meet in order, one row each; duplicates across
fragments come from an aggregate by digest. Equal rows are counted before the shuffle.

Null roles and texts are one space; a null conv_id is a conversation; null turns come first. Roles whose first letter is none of
s, u and a must be deleted or reroled, empty roles too. Texts are read whole, repeated rows are duplicates, an empty table gives no
rows, other columns are ignored.
"""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strideforge.llm.common import materialize, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
KINDS = ("E", "UU", "UA", "AU", "AA", "S", "SU", "SA")
STARTS = ("E", "UA", "SA")
FRAGMENT_ROWS, FRAGMENT_CHARS = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"


def rules():
    """(left, right, joined) of all binary rules."""
    found = [("E", k, k) for k in KINDS] + [(k, "E", k) for k in KINDS[1:]]
    found += [(x + z, w + y, x + y) for x in "UAS" for z, w in ("UA", "AU") for y in "UA" if x + z in KINDS]
    return found + [("S", "U" + y, "S" + y) for y in "UA"]


RULES = rules()


def joined(left, right):
    """The cell of a span from the cells of its two parts."""
    cell = {}
    for a, b, k in RULES:
        if a in left and b in right:
            (c1, s1), (c2, s2) = left[a], right[b]
            best = cell.get(k)
            if best is None or c1 + c2 <= best[0]:
                new = (c1 + c2, s1 + s2)
                if best is None or new < best:
                    cell[k] = new
    return cell


INSERTED = {"UU": (INSERT, "I"), "AA": (INSERT, "I")}


def closed(cell):
    """The cell with rows inserted before and after its span wherever that gives a nonterminal more cheaply."""
    while True:
        found = dict(cell)
        for other in (joined(INSERTED, cell), joined(cell, INSERTED)):
            for k, v in other.items():
                if k not in found or v < found[k]:
                    found[k] = v
        if found == cell:
            return cell
        cell = found


def leaf(code):
    """The closed cell of one row: code x (must go), or the first letter of its role (o: any other), a capital if truncated."""
    cell = {"E": (DELETE, "D")}
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        kind = {"u": "UU", "a": "AA", "s": "S"}.get(code.lower())
        cell |= {k: (REROLE + extra, "R") for k in ("UU", "AA")}
        if kind:
            cell[kind] = (KEEP + extra, "K")
    return closed(cell)


LEAVES = {c: leaf(c) for c in "xuasoUASO"}
EMPTY = {"E": (0, "")}


def parse(codes):
    """The cell of all rows, bottom-up by span length."""
    cells = [LEAVES[c] for c in codes] or [EMPTY]
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell):
    """(cost, audit) of the cheapest legal repair."""
    return min(cell[k] for k in STARTS if k in cell)


def initial(role):
    return role[:1]


def faults(rows, late=frozenset()):
    """Fault of each row (role, text): "", blank, duplicate, truncated. late: places of rows that stood in an earlier fragment."""
    seen, found = set(), []
    for i, row in enumerate(rows):
        end = row[1].rstrip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if row in seen or i in late else "truncated" if end not in ".!?" else ""
        seen.add(row)
        found.append(fault)
    return found


def code_of(role, fault):
    if fault in ("blank", "duplicate"):
        return "x"
    letter = initial(role) if initial(role) in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def apply(rows, audit, last=""):
    """Messages (role, text, edit) of the rows after the edits; last: first letter of the role before them."""
    at, out = 0, []
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text = ("assistant" if last == "u" else "user", "")
        if edit != "I":
            role, text = (rows[at][0] if edit == "K" else role, rows[at][1])
            at += 1
        out.append((role, text, edit))
        last = initial(role)
    return out


LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def summary(turns, rows, found):
    """What neighbouring fragments need of each other for the report: counts, turns and roles at both ends."""
    real = [t for t in turns if t is not None]
    roles = [initial(r) for r, _ in rows]
    out = {k: found.count(k) for k in COUNTS[:3]}
    out["illegal"] = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
    return out | {"low": min(real, default=None), "high": max(real, default=None), "turns": len(set(real)), "rows": len(rows), "first": roles[0] if rows else "", "last": roles[-1] if rows else ""}


def merged(a, b):
    """The summary of two neighbouring stretches of a conversation."""
    if not a["rows"] or not b["rows"]:
        return b if not a["rows"] else a
    out = {k: a[k] + b[k] for k in (*COUNTS, "turns", "rows")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    low, high = [x["low"] for x in (a, b) if x["low"] is not None], [x["high"] for x in (a, b) if x["high"] is not None]
    return out | {"low": min(low, default=None), "high": max(high, default=None), "first": a["first"], "last": b["last"]}


def gaps(s):
    return 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
MESSAGES = "messages array<struct<role:string,text:string,edit:string>>"
CUT = f"{REPORT}, part long, whole boolean, {MESSAGES}, turns array<long>"


def as_messages(rows):
    return [{"role": r, "text": t, "edit": e} for r, t, e in rows]


def _report(conv_id, s, cost, audit):
    return {"conv_id": conv_id, "gaps": gaps(s), **{k: s[k] for k in COUNTS}, "cost": cost, "audit": audit}


#: Cells of sequences of codes that a task remembers.
MEMO = 50_000


class _Fragments:
    """Cuts the sorted rows of a partition into fragments and solves the conversations that lie inside it."""

    def __init__(self, part, limit=FRAGMENT_ROWS):
        self.part, self.limit, self.memo, self.out = part << 32, limit, {}, []
        self.id, self.turns, self.rows, self.chars = None, [], [], 0
        self.begun, self.inside, self.cut = False, False, False

    def solved(self, codes):
        if codes not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[codes] = best(parse(codes))
        return self.memo[codes]

    def flush(self, ends):
        """Put out the fragment in hand; ends: the conversation ends with it for certain."""
        whole = self.inside and ends and not self.cut
        row = dict.fromkeys(c.split()[0] for c in REPORT.split(", ")) | {"conv_id": self.id, "part": self.part, "whole": whole, "turns": [] if whole else self.turns}
        if whole:
            found = faults(self.rows)
            cost, audit = self.solved("".join(code_of(r, f) for (r, _), f in zip(self.rows, found)))
            row |= _report(self.id, summary(self.turns, self.rows, found), cost, audit) | {"messages": as_messages(apply(self.rows, audit))}
        else:
            row["messages"] = as_messages((r, t, "") for r, t in self.rows)
        self.out.append(row)
        self.part += 1
        self.turns, self.rows, self.chars = [], [], 0

    def add(self, conv_id, turn, role, text, n):
        if self.begun and conv_id != self.id:
            self.flush(True)
            self.inside, self.cut = True, False
        self.begun, self.id = True, conv_id
        for _ in range(n):
            if len(self.rows) >= self.limit or self.chars >= FRAGMENT_CHARS:
                self.flush(False)
                self.cut = True
            self.turns.append(turn)
            self.rows.append((role, text))
            self.chars += len(text)


def arrow_schema(ddl):
    return to_arrow_schema(StructType.fromDDL(ddl))


def cut(rows, fragment_rows=FRAGMENT_ROWS):
    """Fragments of rows(conv_id, turn, role, text, n), sorted over all partitions; n: how often a row stands, 0 for none."""
    schema = arrow_schema(CUT)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        state = _Fragments(TaskContext.get().partitionId(), fragment_rows)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                for row in zip(*(batch.slice(a, 500).column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n"))):
                    state.add(*row)
                if state.out:
                    yield pa.RecordBatch.from_pylist(state.out, schema)
                    state.out = []
        if state.begun:
            state.flush(False)
            yield pa.RecordBatch.from_pylist(state.out, schema)

    return rows.mapInArrow(run, CUT)


CELLS = "conv_id long, part long, cells array<struct<kind:string,cost:long,audit:string>>, s struct<blank:long,duplicate:long,truncated:long,illegal:long,low:long,high:long,turns:long,rows:long,first:string,last:string>"


def _by_rows(frame, make, ddl):
    """frame's rows, a few at a time, each replaced by what make gives for it as a dict."""
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 4):
                found = [x for row in batch.slice(a, 4).to_pylist() for x in make(row)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    return frame.mapInArrow(run, ddl)


def _cells(row):
    rows = [(m["role"], m["text"]) for m in row["messages"]]
    found = faults(rows, frozenset(row["late"] or ()))
    cell = parse("".join(code_of(r, f) for (r, _), f in zip(rows, found)))
    yield {"conv_id": row["conv_id"], "part": row["part"], "cells": [{"kind": k, "cost": c, "audit": a} for k, (c, a) in cell.items()], "s": summary(row["turns"], rows, found)}


CHOSEN = f"{REPORT}, part long, edits string, last string"


def _chosen(row):
    """Fragments of one conversation, in order: its report with the first one, each one's edits and the role before it."""
    parts = sorted(row["parts"], key=lambda p: p["part"])
    cell, steps, total = EMPTY, [], summary([], [], [])
    for p in parts:
        here = {c["kind"]: (c["cost"], c["audit"]) for c in p["cells"]}
        after, back = {}, {}
        for a, b, k in RULES:
            if a in cell and b in here:
                new = (cell[a][0] + here[b][0], cell[a][1] + here[b][1])
                if k not in after or new < after[k]:
                    after[k], back[k] = new, (a, here[b][1])
        cell = after
        steps.append(back)
        total = merged(total, p["s"])
    cost, audit = best(cell)
    kind = min((k for k in STARTS if k in cell), key=lambda k: cell[k])
    edits = []
    for back in reversed(steps):
        kind, text = back[kind]
        edits.append((text, "" if kind == "E" else kind[-1].lower()))
    for i, (p, (text, last)) in enumerate(zip(parts, reversed(edits))):
        head = _report(row["conv_id"], total, cost, audit) if not i else {"conv_id": row["conv_id"]}
        yield dict.fromkeys(c.split()[0] for c in CHOSEN.split(", ")) | head | {"part": p["part"], "edits": text, "last": last}


def _edited(row):
    rows = [(m["role"], m["text"]) for m in row["messages"]]
    yield {"conv_id": row["conv_id"], "part": row["part"], "messages": as_messages(apply(rows, row["edits"], row["last"]))}


def solve(conversations, times=None, fragment_rows=FRAGMENT_ROWS):
    """(whole, reports, pieces) of conversations(conv_id, turn, role, text): see ``repair``; whole has both for those of one piece.

    times: a column that says how often a row stands; a conversation whose rows all stand 0 times is there with no rows.
    """
    n = F.col(times) if times else F.lit(1)
    here = n > 0
    space = lambda c: F.when(here, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(here, F.col("turn")).cast("long").alias("turn"), space("role"), space("text"), n.cast("long").alias("n"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    found = materialize(cut(rows.orderBy("conv_id", "turn", "role", "text"), fragment_rows), "conversations")
    whole, spread = found.filter("whole"), found.filter("not whole")

    # a row is a duplicate too if its role and text stood in an earlier fragment
    places = spread.select("conv_id", "part", F.posexplode("messages").alias("at", "m"))
    digest = F.sha2(F.encode(F.concat(F.length("m.role").cast("string"), F.lit(":"), "m.role", "m.text"), "UTF-8"), 256)
    places = places.select("conv_id", "part", "at", digest.alias("d"))
    first = places.groupBy("conv_id", "d").agg(F.min("part").alias("first"))
    same = F.col("f.conv_id").eqNullSafe(F.col("p.conv_id"))
    late = places.alias("p").join(first.alias("f"), same & (F.col("f.d") == F.col("p.d")) & (F.col("p.part") > F.col("f.first")))
    late = late.groupBy("p.conv_id", "p.part").agg(F.collect_list("p.at").alias("late"))
    told = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))
    with_late = spread.alias("a").join(late.alias("b"), told("a", "b"), "left").select("a.conv_id", "a.part", "a.messages", "a.turns", "b.late")
    cells = _by_rows(with_late, _cells, CELLS)
    parts = cells.groupBy("conv_id").agg(F.collect_list(F.struct("part", "cells", "s")).alias("parts"))
    chosen = materialize(_by_rows(parts, _chosen, CHOSEN), "edits")
    pieces = spread.alias("a").join(chosen.alias("b"), told("a", "b")).select("a.conv_id", "a.part", "a.messages", "b.edits", "b.last")
    report = [c.split()[0] for c in REPORT.split(", ")]
    return whole.select(*report, "part", "messages"), chosen.filter("cost is not null").select(*report), _by_rows(pieces, _edited, f"conv_id long, part long, {MESSAGES}")


def repair(conversations, times=None, fragment_rows=FRAGMENT_ROWS):
    """(reports, pieces): a row per conversation with gaps, counts of faults, cost and audit; the repaired messages in pieces.

    pieces has conv_id, part and messages (role, text, edit) in order; those of a conversation follow each other by part.
    """
    whole, reports, pieces = solve(conversations, times, fragment_rows)
    return whole.select(*reports.columns).union(reports), whole.select(*pieces.columns).union(pieces)


def damaged(conversations):
    """conversations with the damage that the query's contract plants by the checksum of conv_id:turn; n: how often a row stands."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(h == 4, "user").otherwise(blank("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"))


def digests(pieces):
    """conv_id and repaired_sha256 of conversations in several pieces: each one's lines pass through one digest, piece by piece."""

    def run(batches):
        import pyarrow as pa

        current, state, empty, out = None, None, True, []
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for batch in batches:
            for conv_id, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
                if state is None or conv_id != current:
                    if state is not None:
                        out.append({"conv_id": current, "repaired_sha256": state.hexdigest()})
                    current, state, empty = conv_id, hashlib.sha256(), True
                if lines is not None:
                    state.update((lines if empty else "\n" + lines).encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": state.hexdigest()}], schema)

    rows = pieces.select("conv_id", "part", F.when(F.size("messages") > 0, lines_of("messages")).alias("lines"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, "conv_id long, repaired_sha256 string")


def lines_of(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def op13_conversation_repair(spark, sf_dir, fragment_rows=FRAGMENT_ROWS):
    whole, reports, pieces = solve(damaged(table(spark, sf_dir, "conversations")), "n", fragment_rows)
    report = reports.columns
    one = whole.select(*report, F.sha2(F.encode(lines_of("messages"), "UTF-8"), 256).alias("repaired_sha256"))
    same = F.col("r.conv_id").eqNullSafe(F.col("d.conv_id"))
    many = reports.alias("r").join(digests(pieces).alias("d"), same).select("r.*", "d.repaired_sha256")
    return one.union(many)


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

#: The damage (CRC-32 by its bits), the counts, and the repair as a walk over the rows that keeps the best way to each state of the
#: automaton of legal roles: b begin, s, u, a by the last letter.
TWIN = """
with recursive keyed as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), sums as (
  select k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384)))) % 20 as h
  from (select distinct k from keyed)
), damaged as (
  select conv_id, turn, case when h = 4 then 'user' else coalesce(role, ' ') end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, h
  from keyed join sums using (k)
), after as (
  select conv_id, turn, role, text from damaged, range(case when h = 3 then 2 else 1 end) where h <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as r from after
), faulty as (
  select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(r) over (partition by conv_id order by i) || r as pair
  from placed
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faulty group by conv_id
), step(f, t) as (values ('b', 's'), ('b', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserts(f, t, c, a, o) as (values ('b', 'b', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('b', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'u', 3, 'I', chr(10) || 'user:'),
  ('a', 'u', 3, 'I', chr(10) || 'user:'), ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('b', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('a', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:')),
edits as (
  select conv_id, i, f, f as t, 4 as c, 'D' as a, '' as o from faulty, (values ('b'), ('s'), ('u'), ('a')) s(f)
  union all
  select conv_id, i, f, t, case when fault = 'truncated' then 3 else 0 end, 'K', chr(10) || role || ':' || text from faulty join step on r = t where fault not in ('blank', 'duplicate')
  union all
  select conv_id, i, f, t, case when fault = 'truncated' then 6 else 3 end, 'R', chr(10) || case t when 'u' then 'user:' else 'assistant:' end || text from faulty, step where t in ('u', 'a') and fault not in ('blank', 'duplicate')
), moves as (
  select e.conv_id, e.i, n.f, e.t, min({'c': n.c + e.c, 'a': n.a || e.a, 'o': n.o || e.o}) as m
  from edits e join inserts n on n.t = e.f group by all
), walk(conv_id, i, t, c, a, o) as (
  select distinct conv_id, 0::bigint, 'b', 0, '', '' from conversations
  union all
  select conv_id, i, t, b.c, b.a, b.o from (
    select w.conv_id, m.i, m.t, min({'c': w.c + m.m.c, 'a': w.a || m.m.a, 'o': w.o || m.m.o}) as b
    from walk w join moves m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1 and m.f = w.t group by all)
), ends as (
  select w.conv_id, min({'c': w.c + n.c, 'a': w.a || n.a, 'o': w.o || n.o}) as b
  from walk w left join counts k on k.conv_id is not distinct from w.conv_id join inserts n on n.f = w.t
  where w.i = coalesce(k.n, 0) and n.t in ('a', 'b') group by w.conv_id
)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, b.c::bigint as cost, b.a as audit, sha256(substr(b.o, 2)) as repaired_sha256
from ends e left join counts k on k.conv_id is not distinct from e.conv_id
"""
ORACLE_SQL = {"op13_conversation_repair": TWIN}
