"""Periodic runs in texts: words that repeat with a fixed period, found online by dyadic square catching.

A run is a stretch of consecutive words in which words q apart are the same, q being its smallest such period, of at least
``min_exponent`` periods and ``min_length`` words, that no neighbouring word extends.

``SquareCatcher`` takes the words of a text one by one. Whenever a block of a power of two words is complete (from a multiple of
its size on), it becomes a catcher: for as long as its level asks, each appended word compares the block's name (a rolling hash)
with that of the text's suffix of the same size. When they agree at a distance q, the suffixes that end q words apart are compared
word by word, backwards, which verifies the block and gives where the stretch starts; from then on each appended word advances
the comparison at distance q by one. A stretch that has reached 2 q words is a square, all later words end new squares of the same
stretch, and they merge into one run, closed by the first word that differs. Level j serves the periods q for which any run holds
a whole block of 2**j words and its copy: 2**(j+1) - 1 <= (min_exponent - 1) q. A level has less than two live catchers on
average, so a word takes a number of steps that grows with the logarithm of the text.

A period that a shorter one divides gives the same stretch: it is not followed where the shorter one already is, and stretches that
were found twice keep the smaller period.

Words are ``[^\\x20\\x09-\\x0D]+``, compared by bytes. Null and empty texts and texts of white space have no words, no runs and
an empty collapsed text. Texts are read whole; a word takes about 40 bytes while its text is scanned. Repeated rows are scanned
alike, null ids stay null, other columns are ignored, an empty table gives no rows. No row meets another one: nothing is shuffled,
so hot sources and groups of copies cost no more than other rows.
"""

import zlib
from array import array

from pyspark.sql import functions as F

from strideforge.llm.common import ascii_words, slices, table

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Modulus and base of the names of blocks.
MODULUS, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
#: A run of at least 4 periods and 6 words is first caught at a word that ends a copy of this many earlier words.
SEED = 4


def levels(min_exponent, upto=48):
    """(size of blocks, smallest and largest period, BASE ** size) of each level that serves any period."""
    least = lambda j: -(-(2 ** (j + 1) - 1) // (min_exponent - 1))
    rows = [(1 << j, least(j), least(j + 1) - 1, pow(BASE, 1 << j, MODULUS)) for j in range(upto)]
    return [r for r in rows if r[1] <= r[2]]


class SquareCatcher:
    """Runs of a growing sequence of words (integers): ``append`` each word, then ``finish``."""

    def __init__(self, min_exponent=MIN_EXPONENT, min_length=MIN_LENGTH):
        if min_exponent < 2:
            raise ValueError("min_exponent must be 2 or more")
        self.exponent, self.least = min_exponent, min_length
        self.levels = levels(min_exponent)
        self.words, self.prefix = array("q"), array("Q", [0])
        self.names = [array("Q") for _ in self.levels]
        self.following, self.closed = {}, {}

    def append(self, word, may_end=True):
        """Add a word; the squares that end with it as (start of its stretch, period).

        may_end=False says that no copy of an earlier block ends here, which spares looking for one.
        """
        words, prefix, following = self.words, self.prefix, self.following
        i = len(words)
        words.append(word)
        prefix.append((prefix[i] * BASE + word + 1) % MODULUS)
        n = i + 1
        for (size, _, _, power), names in zip(self.levels, self.names):
            if n % size:
                break
            names.append((prefix[n] - prefix[n - size] * power) % MODULUS)
        if following:
            for q in [q for q in following if words[i - q] != word]:
                self._close(q, i)
        if may_end:
            self._catch(n)
        return [(s, q) for q, s in following.items() if n - s >= 2 * q] if following else []

    def _catch(self, n):
        prefix, following = self.prefix, self.following
        for (size, low, high, power), names in zip(self.levels, self.names):
            at = n - size
            if at < low:
                break
            first, last = max(0, -((high - at) // size)), (at - low) // size
            if first > last:
                continue
            name = (prefix[n] - prefix[at] * power) % MODULUS
            for k in range(first, last + 1):
                if names[k] == name:
                    q = at - k * size
                    if q in following or any(q % a == 0 and n - s > q for a, s in following.items()):
                        continue
                    back = self._suffix(n, q)
                    if back >= size:
                        following[q] = n - back - q

    def _suffix(self, n, q):
        """Number of words for which the suffixes that end q apart, the later one with the last of n words, agree."""
        words, back, step = self.words, 0, 16
        while step and back < n - q:
            step = min(step, n - q - back)
            a = n - back - step
            if words[a : a + step] == words[a - q : a - q + step]:
                back, step = back + step, 2 * step
            else:
                step //= 2
        return back

    def _close(self, q, end):
        s = self.following.pop(q)
        if end - s >= max(self.least, self.exponent * q):
            self.closed[s, end] = min(q, self.closed.get((s, end), q))

    def finish(self):
        """All runs as (start, length, period), by start, then period."""
        for q in list(self.following):
            self._close(q, len(self.words))
        return sorted(((s, e - s, q) for (s, e), q in self.closed.items()), key=lambda r: (r[0], r[2]))


def copies_end(codes, offsets):
    """Of each word: does it end a copy of ``SEED`` earlier words of its text? (By hashes, so now and then one too many.)"""
    import numpy as np

    found = np.zeros(len(codes), bool)
    if len(codes) < SEED:
        return found
    key = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[SEED - 1 :].astype(np.uint64)
    for k in range(SEED):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - SEED + 1 + k].astype(np.uint64)
    whole = np.ones(len(codes), bool)
    for k in range(SEED - 1):
        at = offsets[:-1] + k
        whole[at[at < offsets[1:]]] = False
    places = np.flatnonzero(whole[SEED - 1 :])
    order = places[np.argsort(key[places], kind="stable")]
    found[order[1:][key[order[1:]] == key[order[:-1]]] + SEED - 1] = True
    return found


def runs_of(codes, min_exponent=MIN_EXPONENT, min_length=MIN_LENGTH, ends=None):
    """Runs (start, length, period) of one sequence of word numbers; ends: flags as of ``copies_end``, where they are known."""
    catcher = SquareCatcher(min_exponent, min_length)
    if ends is None or min_exponent < 4 or min_length < 6:
        ends = [True] * len(codes)
    for word, end in zip(codes, ends):
        catcher.append(word, end)
    return catcher.finish()


def collapsed(words, runs):
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep) if k]


def find(docs, min_exponent=MIN_EXPONENT, min_length=MIN_LENGTH):
    """Per row of docs(doc_id, text): doc_id, runs: array of (start, length, period) in words, collapsed: the text without repeats.

    The collapsed text has its kept words joined by one space.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                codes, offsets, _ = ascii_words(part.column("text"))
                ends = copies_end(codes, offsets)
                some = np.add.reduceat(np.append(ends, False), offsets[:-1]) * (np.diff(offsets) > 0) if len(offsets) > 1 else []
                if min_exponent < 4 or min_length < 6:
                    some = np.diff(offsets)
                runs, texts = [], []
                for r, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    a, b = offsets[r], offsets[r + 1]
                    found = runs_of(codes[a:b].tolist(), min_exponent, min_length, ends[a:b].tolist()) if some[r] else []
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(collapsed((text or b"").split(), found)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted(docs):
    """docs(doc_id, text) with the runs that the query's contract plants: a tenth of the texts, by the checksum of the id, go on periodically.

    Such texts come back as words joined by one space, all others as they are; a null id plants nothing.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                texts = []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    h = 1 if i is None else zlib.crc32(str(i).encode())
                    words = text.encode().split() if h % 10 == 0 else []
                    n, g = len(words), h // 10
                    if n:
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        cycle = words[a : a + p]
                        text = b" ".join(words[:a] + (cycle * ((n - a) // p + 1))[: n - a]).decode()
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def op11_square_runs(spark, sf_dir):
    found = find(with_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    length, start, period = -F.col("_b.l"), F.col("_b.s"), F.col("_b.p")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * -_b.l div _b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op11_square_runs": op11_square_runs}
ORACLE_SQL = {}
