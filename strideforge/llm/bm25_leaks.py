"""Documents that contain benchmark items: BM25 over an inverted index of the items with block-max WAND, then overlap.

A document leaks an item if some run of at most half as many words again as the item has (its window) holds at least ``overlap``
of the item's five-word shingles, and at least half of those of its question and of its answer. Question and answer are the
parts of an item before and after its first line feed; without one, the item is all question.

The items are the indexed side: postings of word -> (item, impact), in the order of the items, in blocks with their largest
impact. Every passage of every document is a query. An item that overlaps enough can lack only so many words of the passage
(one for each missing shingle), so its least score is its own score less its largest impacts; impacts are divided by that, so
one threshold (1) serves all items and no pair that the overlap would confirm is lost, whatever else is in the index. WAND
runs for many passages at once: in each step, the cursors of a passage's words are put in order, the pivot is the first item
where the sum of the words' largest impacts reaches the threshold, and its block is skipped if the sum of the block's largest
impacts does not; else the item is scored. Items above the threshold are retrieved, and verified in their own window.

Items go by the size of their window, the next power of two: a document is cut into passages of twice that size that overlap by
half, so each window lies whole in one of them. What is found for an item thus depends on that item alone: neither other
items, nor the size of a group, nor the place in the document matter.

Items are broadcast in groups of at most ``group_items`` items and about ``group_words`` words (by a hash of the id), each group
with its own pass over the documents, so a large benchmark costs passes, not memory. Words are runs of letters and digits in
lower case. Null and empty texts match nothing; an item without words matches nothing; an item shorter than five words counts
as one shingle. Documents without an id are scanned like others (``_id`` and ``_th`` tell rows apart). Repeated rows of
documents and items give each pair once, ties of windows the best shares. Empty tables give no rows. Texts of any length are
scanned whole. Other columns are ignored.
"""

from pyspark.sql import functions as F

from strideforge.llm.common import NULL_ID, keyed, slices, table

K1, B = 1.2, 0.75
#: Shares of the shingles of an item, and of its question and its answer, that make a leak.
OVERLAP, PART = 0.8, 0.5
WIDTH, BLOCK, GROUP_ITEMS, GROUP_WORDS = 5, 8, 20_000, 2_000_000
#: Passages that are searched at once, and the slack of sums of floating point numbers.
AT_ONCE, SLACK = 2048, 1e-9
ITEM = 2**40


def words_of(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def shingles(words, width=WIDTH):
    """Distinct shingles; fewer words than the width are one shingle."""
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def window(n_words):
    """Words of a document among which an item of so many words has to be found."""
    return n_words + n_words // 2


def missing_words(n_words, n_shingles, overlap):
    """Distinct words that a passage with the needed overlap can lack at most.

    Without repeated shingles each missing one takes one word more (the others are in its neighbours); with repeated ones a word
    goes with the shingle that it ends, but for the first four words.
    """
    lost = int((1 - overlap) * n_shingles + 1e-9)
    if n_shingles == max(1, n_words - WIDTH + 1):
        return lost
    return min(WIDTH * lost, lost + WIDTH - 1)


class Postings:
    """Items of one size of windows: their postings in order of word and item, with block maxima, and the search."""

    def __init__(self, step, rows, n_words):
        """rows: (word, item, impact over the item's least score), words numbered from 0."""
        import numpy as np

        self.step = step
        rows.sort()
        word, item, self.impact = (np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int64, np.float64)))
        self.key = word * ITEM + item
        self.item = np.append(item, ITEM - 1)  # behind the last one: no item
        self.start = np.searchsorted(word, np.arange(n_words))
        self.end = np.searchsorted(word, np.arange(n_words), "right")
        self.most = np.zeros(n_words)
        np.maximum.at(self.most, word, self.impact)
        block = word * ITEM + item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        self.block, self.block_most = block[first], np.maximum.reduceat(self.impact, first)

    def items_at(self, cursor, word):
        """The items under the cursors; ITEM - 1 where a word's postings are over."""
        import numpy as np

        return np.where(cursor < self.end[word], self.item[np.minimum(cursor, len(self.item) - 1)], ITEM - 1)

    def search(self, words, starts, ends):
        """(passage, item, score) of all items that reach the threshold, for passages words[start:end] of distinct words."""
        import numpy as np

        found = []
        upper = np.add.reduceat(self.most[words], starts) if len(starts) else starts
        todo = np.flatnonzero(upper >= 1 - SLACK)  # no pivot otherwise
        todo = todo[np.argsort((ends - starts)[todo], kind="stable")]
        for lo in range(0, len(todo), AT_ONCE):
            rows = todo[lo : lo + AT_ONCE]
            n = (ends - starts)[rows]
            place = np.arange(n.max())[None]
            there = place < n[:, None]
            word = words[np.where(there, starts[rows][:, None] + place, 0)]
            most = np.where(there, self.most[word], 0.0)
            cursor = self.start[word]
            item = np.where(there, self.items_at(cursor, word), ITEM - 1)
            while len(rows):
                order = np.argsort(item, axis=1)
                sums = np.cumsum(np.take_along_axis(np.where(item < ITEM - 1, most, 0.0), order, 1), axis=1)
                alive = sums[:, -1] >= 1 - SLACK
                if not alive.all():
                    rows, word, most, cursor, item, order, sums = (x[alive] for x in (rows, word, most, cursor, item, order, sums))
                    if not len(rows):
                        break
                pivot_at = (sums < 1 - SLACK).sum(1)
                pivot = item[np.arange(len(rows)), order[np.arange(len(rows)), pivot_at]]
                inside = item <= pivot[:, None]
                # the sum of the maxima of the pivot's block
                r, c = np.nonzero(inside)
                w, p = word[r, c], pivot[r]
                key = w * ITEM + p // BLOCK
                at = np.minimum(np.searchsorted(self.block, key), len(self.block) - 1)
                bound = np.bincount(r, np.where(self.block[at] == key, self.block_most[at], 0.0), len(rows))
                open_ = bound >= 1 - SLACK
                # a skipped block ends where the next cursor or the next block begins
                after = np.where(inside, ITEM - 1, item).min(1)
                target = np.where(open_, pivot, np.minimum(after, (pivot // BLOCK + 1) * BLOCK))
                behind = item[r, c] < target[r]
                r, c, w = r[behind], c[behind], w[behind]
                cursor[r, c] = np.minimum(np.searchsorted(self.key, w * ITEM + target[r]), self.end[w])
                item[r, c] = self.items_at(cursor[r, c], w)
                r, c = np.nonzero((item == pivot[:, None]) & open_[:, None])
                score = np.bincount(r, self.impact[cursor[r, c]], len(rows))
                found += [(int(rows[i]), int(pivot[i]), float(score[i])) for i in np.flatnonzero(open_ & (score >= 1 - SLACK))]
                cursor[r, c] += 1
                item[r, c] = self.items_at(cursor[r, c], word[r, c])
        return sorted(found)


class Index:
    """A bounded group of items: one ``Postings`` for each size of windows, and what the overlap is counted on."""

    def __init__(self, items, idf, mean_length, overlap=OVERLAP):
        self.items = [(i, q, a) for i, q, a in items if q or a]
        self.parts = [(shingles(q + a), shingles(q), shingles(a)) for _, q, a in self.items]
        self.words, rows, self.least = {}, {}, []
        for k, (_, q, a) in enumerate(self.items):
            tf = {}
            for w in q + a:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(q + a) / mean_length)
            impact = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            lost = sorted(impact.values(), reverse=True)[: missing_words(len(q + a), len(self.parts[k][0]), overlap)]
            total = sum(impact.values())
            self.least.append((total - sum(lost)) / total)
            step = max(8, 1 << (window(len(q + a)) - 1).bit_length())
            for w, x in impact.items():
                rows.setdefault(step, []).append((self.words.setdefault(w, len(self.words)), k, x / (total - sum(lost)) if total > sum(lost) else 1.0))
        self.sizes = [Postings(step, r, len(self.words)) for step, r in sorted(rows.items())]

    def shares(self, k, text, overlap=OVERLAP):
        """Best shares (whole, question, answer) of item k in a window of the words, or None where it is no leak."""
        whole, question, answer = self.parts[k]
        _, q, a = self.items[k]
        places = []  # (start, end, shingle) of all that occur
        for width in {len(g) for part in self.parts[k] for g in part}:
            wanted = {g for part in self.parts[k] for g in part if len(g) == width}
            for i in range(len(text) - width + 1):
                if (g := tuple(text[i : i + width])) in wanted:
                    places.append((i, i + width, g))
        places.sort()
        best, size = None, window(len(q + a))
        for n, (start, _, _) in enumerate(places):
            if n and places[n - 1][0] == start:
                continue
            have = {g for i, e, g in places[n:] if e <= start + size}
            share = tuple(len(have & part) / len(part) if part else 1.0 for part in (whole, question, answer))
            if share[0] >= overlap and min(share[1:]) >= PART and (best is None or share > best):
                best = share
        return best


def passages(offsets, where, code, step, n_words):
    """Distinct words of the passages of 2 * step words that start at every step of a row: words, starts, ends, row, first word.

    where: the places of the words that the index has, code: their numbers; offsets: the rows' ends among all words.
    """
    import numpy as np

    row = np.searchsorted(offsets, where, "right") - 1
    n = np.diff(offsets)
    last = np.maximum(0, (n - 1) // step - 1)  # the last passage that holds a word that the one before lacks
    base = np.concatenate([[0], np.cumsum(last + 1)])
    k = (where - offsets[row]) // step
    own, before = k <= last[row], k > 0
    pairs = np.concatenate([(base[row] + k)[own] * n_words + code[own], (base[row] + k - 1)[before] * n_words + code[before]])
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    passage, word = np.divmod(pairs, n_words)
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    row = np.searchsorted(base, passage[starts], "right") - 1
    return word, starts, np.append(starts[1:], len(passage)), row, offsets[row] + (passage[starts] - base[row]) * step


def _pass(index, overlap):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        ix = index.value
        n_words = len(ix.words)
        indexed = [p.end > p.start for p in ix.sizes]
        for batch in batches:
            for part in slices(batch, "_bytes"):
                out = []
                lists = part.column("words")
                offsets = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
                coded = lists.flatten().dictionary_encode()
                names = coded.dictionary.to_pylist()
                known = np.array([ix.words.get(w, -1) for w in names], np.int64)
                codes = np.asarray(coded.indices).astype(np.int64)
                v = known[codes] if len(codes) else codes
                for postings, own in zip(ix.sizes, indexed):
                    where = np.flatnonzero((v >= 0) & own[v])
                    if not len(where):
                        continue
                    word, starts, ends, row, first = passages(offsets, where, v[where], postings.step, n_words)
                    for i, k, score in postings.search(word, starts, ends):
                        r, a = int(row[i]), int(first[i])
                        text = [names[c] for c in codes[a : min(offsets[r + 1], a + 2 * postings.step)]]
                        if share := ix.shares(k, text, overlap):
                            out.append((*(part.column(c)[r].as_py() for c in ("_id", "_th")), ix.items[k][0], score * ix.least[k], *share))
                if out:
                    types = (*[pa.int64()] * 3, *[pa.float64()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], NAMES)

    return run


NAMES = ["_id", "_th", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
FOUND = "_id long, _th long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def leaks(docs, benchmark, overlap=OVERLAP, group_items=GROUP_ITEMS, group_words=GROUP_WORDS):
    """Pairs of docs(doc_id, text) and benchmark(item_id, text) that leak, with the best window's shares; one row a pair.

    Columns: doc_id, item_id, score (BM25 as a share of the item's own), overlap, question_overlap, answer_overlap, and _id, _th,
    the key of ``common.keyed``, by which ``common.without`` removes rows.
    """
    import math

    spark = docs.sparkSession
    lower = F.lower("text")
    cut = F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = keyed(docs).select("_id", "_th", cut.alias("words"), F.octet_length(lower).alias("_bytes"))
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    split = F.expr("instr(text, '\n')")
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    items = items.select(
        "item_id",
        tokens(F.when(split > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text"))).alias("q"),
        tokens(F.when(split > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))).alias("a"),
    )
    n, mean = items.agg(F.count("*"), F.avg(F.size("q") + F.size("a"))).first()
    groups = max(-(-n // group_items), math.ceil(n * (mean or 0) / group_words))
    out = None
    for g in range(groups):
        group = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        rows = [(r.item_id, list(r.q), list(r.a)) for r in group.orderBy("item_id", "q", "a").collect()]
        own = spark.createDataFrame([(w,) for w in sorted({w for _, q, a in rows for w in q + a})], "word string")
        seen = items.select(F.explode(F.array_distinct(F.concat("q", "a"))).alias("word")).join(F.broadcast(own), "word").groupBy("word").count()
        idf = {r["word"]: math.log(1 + (n - r["count"] + 0.5) / (r["count"] + 0.5)) for r in seen.collect()}
        index = Index(rows, idf, mean or 1, overlap)
        if not index.items:
            continue
        part = words.mapInArrow(_pass(spark.sparkContext.broadcast(index), overlap), FOUND)
        out = part if out is None else out.union(part)
    out = spark.createDataFrame([], FOUND) if out is None else out
    best = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap")).alias("b")
    doc_id = F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")
    found = out.groupBy("_id", "_th", "item_id").agg(best)
    return found.select(doc_id, "item_id", "b.score", "b.overlap", "b.question_overlap", "b.answer_overlap", "_id", "_th")


def op6_bm25_leaks(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap")


QUERIES = {"op6_bm25_leaks": op6_bm25_leaks}
ORACLE_SQL = {}
