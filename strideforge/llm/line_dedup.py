"""Removal of multi-line chunks that repeat across documents. DataFrame functions only.

Lines are the pieces of a text after each line feed (``split=LINES``) and, inside a line, after the end of a sentence as well
(``WRAPPED``, the default: texts of whole paragraphs on one line have no other lines), with their ends, so that the pieces
joined give the text. A rolling hash over two line hashes marks a boundary after a line
where it is a strict local minimum; boundaries thus depend on four lines only and survive insertions elsewhere. Chunks lie
between boundaries. A chunk of at least ``min_lines`` lines and ``min_chars`` characters whose hash occurs again is
fetched, compared by its bytes, and removed everywhere but at its first place (smallest doc_id, then line number).

Counting is by partial aggregates, so a chunk that a third of all documents share costs one row per task. Texts are read
again only for documents with repeated hashes, and only texts that may hold something to fetch or to remove (``parted``)
go through a shuffle; it is a sort-merge join at every size, so that figures of small tables tell those of large ones, where
the list of chunks is too large to broadcast. Null text counts as empty; an empty text stays. A null doc_id is an id of
its own, before all others. Rows with equal doc_id and text are one document: all of them get the same text. Other columns
pass through.

A chunk has to lie whole inside a shared passage, so passages of a few lines mostly give none. ``remove_passages``
(``op1_passages``, and the pipeline) takes every pair of neighbouring lines that are not blank instead: a pair that stands in
an earlier place too (the same bytes but for white space at the lines' ends, told by 128 bits of SHA-256) is repeated,
overlapping repeated pairs form a run, and a run of at least ``min_chars`` characters is removed, so a passage goes from its
first whole line to its last. Each line that goes stays in an earlier place. Whole copies of documents can be left out of it
(``copies``), as the pipeline does, which looks for near duplicates next: of a torn copy only fragments would be left to find.
An empty table gives no rows; of equal places the least document and line is the first.
"""

from pyspark.sql import functions as F

from strideforge.llm.common import MAX_BROADCAST, NULL_ID, parted, table
from strideforge.llm.common import materialize as written

#: Where texts are cut into lines: after line feeds only, or after the ends of sentences as well (wrapped text).
LINES, WRAPPED = r"(?<=\n)", r"(?<=\n)|(?<=[.!?] )"
#: Factor and modulus of the rolling hash over two 32-bit line hashes (fixed values).
FACTOR, MODULUS = 1000003, 2147483647
MIN_LINES, MIN_CHARS = 2, 64
#: Similarity that makes a document a copy of another one, for callers that look for near duplicates afterwards; and the share
#: of the longer one's characters in common lines from which on it is looked at.
COPY, LEAST_COMMON = 0.8, 0.1
MARK = "\x01"


def materialize(df, name):
    """df, written; its shuffles go as soon as it is, so the disk holds those of one step at a time."""
    return written(df, name, release=True)


def _shift(values, first):
    """The array moved right by one, with ``first`` in front."""
    return F.concat(F.array(first), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))


def _chunked(docs, keep, split):
    """docs(text) with chunks (texts, escaped) and lens (lines of each); keep: columns to carry along.

    The boundaries become a mark inside the joined lines, at which the text is split again, so all steps are linear in the
    text. A mark in the text itself is escaped. ``inline`` keeps the arrays from being computed again inside lambdas.
    """
    lines = docs.withColumn("lines", F.split(F.replace("text", F.lit(MARK), F.lit(MARK + "e")), split, -1))
    hashed = lines.withColumn("h", F.transform("lines", lambda u: F.conv(F.substring(F.md5(u), 1, 8), 16, 10).cast("long")))
    rolled = hashed.withColumn(
        "r", F.zip_with(_shift(F.col("h"), F.lit(0).cast("long")), "h", lambda a, b: F.pmod(a * FACTOR + b, F.lit(MODULUS)))
    )
    after = F.concat(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.array(F.lit(-1).cast("long")))
    least = F.zip_with(
        F.zip_with("r", _shift(F.col("r"), F.lit(-1).cast("long")), lambda a, b: F.when(a < b, a)),
        after,
        lambda a, c: F.coalesce(a < c, F.lit(False)),
    )
    ended = rolled.withColumn("ends", least)
    marked = F.array_join(F.zip_with("lines", "ends", lambda u, e: F.when(e, F.concat(u, F.lit(MARK + "s"))).otherwise(u)), "")
    ends = F.concat(F.filter(F.transform("ends", lambda e, i: F.when(e, i)), lambda e: e.isNotNull()), F.array(F.size("lines") - 1))
    both = ended.select(*keep, F.split(marked, MARK + "s", -1).alias("chunks"), ends.alias("ends"))
    lens = F.zip_with("ends", _shift(F.col("ends"), F.lit(-1)), lambda b, a: b - a)
    return both.select(*keep, F.inline(F.array(F.struct("chunks", lens.alias("lens")))))


def repeated_chunks(docs, min_lines=MIN_LINES, min_chars=MIN_CHARS, split=WRAPPED):
    """Chunks of docs(_id, _th, text) to remove: _id, _th, chunk (its number in the document), first places left out."""
    cells = F.zip_with("chunks", "lens", lambda c, n: F.struct(n.alias("len"), F.length(c).alias("chars"), F.xxhash64(c).alias("hash")))
    places = (
        _chunked(docs, ["_id", "_th"], split)
        .select("_id", "_th", F.posexplode(cells).alias("chunk", "c"))
        .select("_id", "_th", "chunk", "c.*")
        .filter((F.col("chars") >= min_chars) & (F.col("len") >= min_lines))
        .select("_id", "_th", "chunk", "hash")
    )
    places = materialize(places, "chunk-places")
    twice = materialize(places.groupBy("hash").count().filter("count > 1").select("hash"), "chunks-twice")
    wanted = places.join(twice, "hash").groupBy("_id", "_th").agg(F.collect_set("chunk").alias("wanted"))
    wanted = materialize(wanted, "chunks-wanted")
    found = _chunked(parted(docs, wanted)[0].join(wanted.hint("merge"), ["_id", "_th"]), ["_id", "_th", "wanted"], split).select(
        "_id", "_th", F.inline(F.transform("wanted", lambda i: F.struct(i.alias("chunk"), F.get("chunks", i).alias("bytes"))))
    )
    found = materialize(found, "chunk-bytes")
    place = F.struct("_id", "_th", "chunk")
    first = found.groupBy("bytes").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    # written first: both sides of the join are then plain exchanges, of which Spark splits the tasks of a frequent chunk
    first = materialize(first.select("bytes", "first"), "chunk-firsts")
    return found.join(first, "bytes").filter(place != F.col("first")).select("_id", "_th", "chunk").distinct()


def remove_repeats(docs, min_lines=MIN_LINES, min_chars=MIN_CHARS, split=WRAPPED):
    """docs with repeated chunks removed from text, and a column n_removed (lines). split: ``LINES`` or ``WRAPPED``."""
    clash = {c: f"_in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64(t).alias("_th"), t.alias("text"),
        *[F.col(f"`{c}`").alias(a) for c, a in clash.items()],
    )
    gone = repeated_chunks(rows.select("_id", "_th", "text"), min_lines, min_chars, split)
    per_doc = materialize(gone.groupBy("_id", "_th").agg(F.collect_set("chunk").alias("gone")), "chunks-gone")
    some, none = parted(rows, per_doc)
    joined = some.join(per_doc.hint("merge"), ["_id", "_th"], "left").withColumn("whole", F.when(F.col("gone").isNull(), F.col("text")))
    joined = joined.withColumn("text", F.when(F.col("gone").isNotNull(), F.col("text")).otherwise(F.lit("")))
    parts = _chunked(joined, ["_id", "whole", "gone", *clash.values()], split)
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "gone"))
    text = F.replace(F.array_join(F.transform(stay, lambda i: F.get("chunks", i)), ""), F.lit(MARK + "e"), F.lit(MARK))
    doc_id = F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")
    out = parts.select(
        doc_id,
        F.coalesce("whole", text).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.aggregate(F.transform("gone", lambda i: F.get("lens", i)), F.lit(0), lambda s, x: s + x)).alias("n_removed"),
        *clash.values(),
    )
    out = out.union(none.select(doc_id, "text", F.lit(0).alias("n_removed"), *clash.values()))
    back = {c: F.col(a).alias(c) for c, a in clash.items() if c != "n_removed"}
    return out.select(*[back.get(c, F.col(c)) for c in docs.columns if c != "n_removed"], "n_removed")


def repeated_runs(docs, min_chars=MIN_CHARS, copies=None, split=WRAPPED):
    """Runs of lines of docs(_id, _th, text) to remove: _id, _th, gone: array of (start, end), line numbers, both removed, in order."""
    lines = F.transform(F.split("text", split, -1), lambda u, i: F.struct(i.alias("i"), F.btrim(u, F.lit(" \t\r\n")).alias("u")))
    size = [] if copies is None else ["size"]  # of the document, needed to tell copies only
    lines = docs.withColumn("size", F.length("text")).select("_id", "_th", *size, F.inline(F.array(F.struct(F.filter(lines, lambda x: x.u != "").alias("n")))))
    rest = F.greatest(F.size("n") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("n", F.lit(1), rest), F.slice("n", F.lit(2), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    places = lines.select("_id", "_th", *size, F.inline(pairs)).select(
        "_id", "_th", *size, F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.length("a.u").alias("chars"), F.length("b.u").alias("last"),
        F.xxhash64("a.u", "b.u").alias("hash"), F.substring(F.unhex(F.sha2(F.concat_ws("\n", "a.u", "b.u"), 256)), 1, 16).alias("bytes"),
    )
    places = materialize(places, "line-pairs")
    twice = materialize(places.groupBy("hash").count().filter("count > 1").select("hash"), "line-pairs-twice")
    found = materialize(places.join(twice, "hash").drop("hash"), "line-pairs-found")
    place = F.struct("_id", "_th", "i", *size)
    first = found.groupBy("bytes").agg(F.min(place).alias("first"), F.max(place).alias("last_place")).filter("first <> last_place")
    # written first: both sides of the join are then plain exchanges, of which Spark splits the tasks of a frequent pair
    first = materialize(first.select("bytes", "first"), "line-pair-firsts")
    gone = found.join(first, "bytes").filter(place != F.col("first"))
    pairs_of = F.collect_set(F.struct("i", "j", "chars", "last")).alias("p")
    if copies is None:
        each = gone.groupBy("_id", "_th").agg(pairs_of)
    else:
        # a row for each document and source, so what follows counts documents, not lines
        gone = gone.withColumns({"id": F.col("first._id"), "th": F.col("first._th")})
        each = gone.groupBy("_id", "_th", "id", "th").agg(pairs_of, F.max(F.greatest("size", "first.size")).alias("size"))
        each = materialize(each, "line-pairs-by-source")
        shared = F.aggregate("p", F.lit(0), lambda s, x: s + x["chars"])
        source = each.filter((F.col("id") != F.col("_id")) | (F.col("th") != F.col("_th"))).filter(shared >= LEAST_COMMON * F.col("size"))
        source = materialize(source.select("_id", "_th", "id", "th"), "line-sources")
        copied = materialize(_copied(docs, source, copies), "line-copies")
        each = each.join(_small(copied), ["_id", "_th", "id", "th"], "left_anti")
        each = each.groupBy("_id", "_th").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"))
    # overlapping pairs form a run: it begins with a pair that no earlier one reaches
    rows = each.select("_id", "_th", F.inline(F.array(F.struct(F.array_sort("p").alias("p")))))
    heads = F.filter(F.transform("p", lambda x, k: F.when((k == 0) | (x["i"] > F.get("p", k - 1)["j"]), k)), lambda k: k.isNotNull())
    rows = rows.select("_id", "_th", "p", F.inline(F.array(F.struct(heads.alias("heads")))))
    ends = F.transform("heads", lambda a, k: F.struct(a.alias("a"), (F.coalesce(F.get("heads", k + 1), F.size("p")) - 1).alias("b")))
    run = lambda r: F.struct(
        F.get("p", r["a"])["i"].alias("start"), F.get("p", r["b"])["j"].alias("end"),
        (F.aggregate(F.slice("p", r["a"] + 1, r["b"] - r["a"] + 1), F.lit(0), lambda s, x: s + x["chars"]) + F.get("p", r["b"])["last"]).alias("chars"),
    )
    kept = F.filter(F.transform(ends, run), lambda r: r["chars"] >= min_chars)
    return rows.select("_id", "_th", F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("gone")).filter(F.size("gone") > 0)


def _small(keys):
    """The written table of keys, to be broadcast up to a checked number of rows."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys


def _copied(docs, pairs, similarity):
    """The pairs of documents (_id, _th, id, th) whose five-word shingles have the similarity; equal texts need no look."""
    a, z = (ord(c) for c in "AZ")
    capitals = "".join(map(chr, range(a, z + 1)))
    words = F.filter(F.split(F.translate("text", capitals, capitals.lower()), "[ \\t-\\r]+", -1), lambda w: w != "")
    near = pairs.filter("_th <> th")
    wanted = _small(materialize(near.select("_id", "_th").union(near.select("id", "th")).distinct(), "line-sources-wanted"))
    cut = docs.join(wanted, ["_id", "_th"], "left_semi").select("_id", "_th", F.inline(F.array(F.struct(words.alias("w")))))
    several = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, 5)))
    sets = F.array_distinct(F.when(F.size("w") >= 5, several).otherwise(F.array(F.xxhash64("w"))))
    sets = materialize(cut.select("_id", "_th", sets.alias("s")), "line-source-sets")
    both = near.join(sets, ["_id", "_th"]).join(sets.select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("s").alias("t")), ["id", "th"])
    both = both.select("_id", "_th", "id", "th", F.size(F.array_intersect("s", "t")).alias("n"), (F.size("s") + F.size("t")).alias("m"))
    alike = both.filter(F.col("n") >= similarity * (F.col("m") - F.col("n"))).select("_id", "_th", "id", "th")
    return alike.union(pairs.filter("_th = th").select("_id", "_th", "id", "th"))


def remove_passages(docs, min_chars=MIN_CHARS, copies=None, count="n_removed", split=WRAPPED):
    """docs with every run of two or more lines that stand in an earlier place removed from text, and a column ``count`` (lines).

    copies: where two documents' five-word shingles have this similarity, the later one is a copy of the earlier one, not a
    text with a repeated passage; what they share stays, for a later search for near duplicates, which could not tell fragments.
    What stands in a third document earlier than both goes from both.
    """
    other = {c: f"_in_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64(t).alias("_th"), t.alias("text"),
        *[F.col(f"`{c}`").alias(a) for c, a in other.items()],
    )
    per_doc = materialize(repeated_runs(rows.select("_id", "_th", "text"), min_chars, copies, split), "line-runs-gone")
    some, none = parted(rows, per_doc)
    joined = some.join(per_doc.hint("merge"), ["_id", "_th"], "left")
    lines = F.when(F.col("gone").isNotNull(), F.split("text", split, -1))
    parts = joined.select("_id", "text", "gone", *other.values(), F.inline(F.array(F.struct(lines.alias("lines")))))
    # what lies before, between and after the runs
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g.end + 1))
    ends = F.concat(F.transform("gone", lambda g: g.start), F.array(F.size("lines")))
    stay = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s.a < s.b)
    stay = F.flatten(F.transform(stay, lambda s: F.sequence(s.a, s.b - 1)))
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "")
    doc_id = F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")
    out = parts.select(
        doc_id,
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.aggregate("gone", F.lit(0), lambda s, g: s + g.end - g.start + 1)).alias(count),
        *other.values(),
    )
    out = out.union(none.select(doc_id, "text", F.lit(0).alias(count), *other.values()))
    back = {c: F.col(a).alias(c) for c, a in other.items() if c != count}
    return out.select(*[back.get(c, F.col(c)) for c in docs.columns if c != count], count)


def op1_line_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_passages(spark, sf_dir):
    return remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op1_passages": op1_passages}
ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) - 1 AS i, unnest(a) AS u
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\\n|[.!?] )', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents)
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(u), 1, 8) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {FACTOR} + h) % {MODULUS} AS r FROM hashed
), ended AS (
  SELECT *, coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, false) AS is_end
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, u, coalesce(sum(CAST(is_end AS INT)) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM ended
), chunks AS (
  SELECT doc_id, c, min(i) AS start, count(*) AS len, string_agg(u, '' ORDER BY i) AS bytes FROM numbered GROUP BY doc_id, c
), ranked AS (
  SELECT doc_id, c, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) AS place FROM chunks
  WHERE len >= {MIN_LINES} AND length(bytes) >= {MIN_CHARS}
), gone AS (SELECT doc_id, c FROM ranked WHERE place > 1)
SELECT n.doc_id, coalesce(string_agg(u, '' ORDER BY i) FILTER (WHERE g.c IS NULL), '') AS text,
  CAST(count(g.c) AS INT) AS n_removed
FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.c = g.c GROUP BY n.doc_id
"""
}
