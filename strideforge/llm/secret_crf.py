"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

Base patterns (each leftmost and non-overlapping, by kind): assign, access, hex, as the contract of ``op4_secret_crf`` gives
them. They always stay.

The field labels the white-space separated tokens of a text as outside, begin or inside of a secret. Its features are the
token's shape (runs of character classes), its core (the longest run of letters, digits and the marks of encodings: length,
mix and changes of classes, variety of letters), its marks (assignment, quotes, address with a user), the shapes of its
neighbours, the neighbouring words themselves, and features of the whole text (share of digits and of long tokens). No labels
exist, so the weights are trained here (gradient steps on the conditional likelihood, by forward and backward sums) on windows
of at most ``max_docs`` documents of the corpus: windows around base matches; windows of plain text; and windows of plain text
into which ``examples`` puts made-up secrets of many forms, most of which no base pattern finds, or harmless look-alikes. Spans
that the decoded labels add, of six characters at least, and that no base span overlaps, have the kind "crf"; quotes, brackets and
commas around them are left out.

Every token of every text is scored. Viterbi runs where it can matter: a token whose outside score exceeds its other scores
by more than the largest possible sum of transition differences is outside in every best path, so such tokens split a text
into short stretches that are decoded on their own with the same result as the whole chain.

Null and empty texts have no spans, texts of any length are scanned whole, and so are words. Repeated rows are scanned alike;
null ids stay null; of labels with equal scores the earlier of outside, begin, inside is taken. An empty table gives no rows and
trains no field. Other columns are ignored.
"""

import re

from pyspark.sql import functions as F

from strideforge.llm.common import ascii_words, least_hashes, materialize, slices, table

# Fixed patterns of the base kinds, in order.
ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
MAX_DOCS, EPOCHS, SIZE = 4000, 8, 1 << 15
#: Training documents are picked from this many times their number, those with the smallest hashes of their text.
LOOKED_AT = 8
OUT, BEGIN, IN = 0, 1, 2
#: Characters of a span that the field adds, at least: those of the base kinds.
LEAST = 6


def base_spans(text):
    """(start, kind number, end) of the base patterns in order.

    A run of the access or hex letters that is too short can hold no longer one, so their least lengths stand in the patterns.
    """
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(found)


class _Classes(dict):
    """Character classes for str.translate: capitals, other letters, digits, some marks as they are, all else."""

    def __missing__(self, code):
        c = chr(code)
        self[code] = k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c in "=:\"'_-/+.@" else "*"
        return k


CLASSES = _Classes()
#: Words of one make up to this many characters have a shape of their own; what tells longer ones apart is their core.
SHORT = 12


# Compiled once: every distinct word goes through some of them.
RUNS, CORE, PARTS = re.compile(r"(.)\1+"), re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[A-Z]+|[a-z]+|[0-9]+")
ASSIGNED = re.compile(r"[A-Za-z_-]{2,}[\"']?[=:][\"']?(?!/)([^\s\"',;]{6,})")
WITH_USER, LONG_PART = re.compile(r"://[^/@:]*:[^/@]+@"), re.compile(r"[A-Za-z0-9_-]{10,}")
KINDS_OF = [(k, re.compile(p)) for k, p in (("A", "[A-Z]"), ("a", "[a-z]"), ("0", "[0-9]"), ("+", "[+/]"), ("_", "[_-]"))]
OTHER = re.compile(r"[^A-Za-z0-9]")


def shape(word):
    """A word's shape: its character classes, each run once, or a digest of many runs; and its size."""
    runs = RUNS.sub(r"\1", word.translate(CLASSES))
    kinds = runs if len(runs) <= SHORT else f"{''.join(sorted(set(runs)))}{len(runs).bit_length()}"
    return f"{kinds}|{min(6, len(word).bit_length())}"


def core(word):
    """What the longest run of letters, digits and +/_- of a word looks like: size, classes, changes of class, variety."""
    best = max(CORE.findall(word), key=len, default="")
    n = len(best)
    if n < 6:
        return f"short{n}"
    parts = PARTS.findall(best)
    plain = sum(map(len, parts))
    classes = "".join(k for k, p in KINDS_OF if p.search(best))
    changes = min(5, 8 * len(parts) // max(1, plain))
    variety = min(4, 5 * len(set(best)) // max(1, min(plain, 36)))
    return f"{classes}|{n.bit_length()}|{n >= 20}|{changes}|{variety}"


def marks(word):
    """Assignment, quotes, an address with a user and a password, dots between long parts."""
    value = ASSIGNED.search(word)
    mixed = bool(value) and sum(bool(p.search(value[1])) for p in (*(p for _, p in KINDS_OF[:3]), OTHER))
    user = bool(WITH_USER.search(word))
    dotted = len(LONG_PART.findall(word)) if "." in word else 0
    return f"{mixed}|{user}|{min(3, dotted)}|{word[:1] in chr(34) + chr(39)}|{word[-1:] in ':='}|{'@' in word and not user}|{'//' in word}"


def looks(word):
    """Shape, core and marks of a word. A word of letters with few changes of case has the same core and marks as all of its size."""
    bare = word.strip(".,;:!?()\"'")
    s = shape(word)
    if bare.isalpha() and s.index("|") <= 5:
        return s, f"word{min(6, len(bare).bit_length())}", word[-1:] if word[-1:] in ":=" else ""
    return s, core(word), marks(word)


#: Distinct words whose features a task remembers.
MEMO = 400_000


def token_features(words, memo=None):
    """Rows for distinct words: shape, shape after and before a token, core, marks, word after and before it; has a digit, is long."""
    import numpy as np
    import xxhash

    memo = {} if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    known = {}
    number = lambda text, seed: known.get((text, seed)) or known.setdefault((text, seed), xxhash.xxh3_64_intdigest(text, seed) % SIZE)
    for w in words:
        if w not in memo:
            s, c, m = looks(w)
            h = xxhash.xxh3_64_intdigest(w.lower().strip("\"',;"), 4)
            memo[w] = (
                number(s, 1), number(s, 2), number(s, 3), number(c, 5), number(m, 6), h % SIZE, (h >> 32) % SIZE,
                any(map(str.isdigit, w)), len(w) > 20,
            )
    return np.array([memo[w] for w in words], np.int64).reshape(-1, 9)


#: Where each feature of a token is looked up: by places away, column.
VIEWS = ((0, 0), (0, 3), (0, 4), (-1, 2), (-1, 5), (1, 1), (1, 6))


def emissions(codes, offsets, words, w, w_file, memo=None):
    """Scores (tokens, 3) by the weights w (SIZE, 3) and w_file (4, 3)."""
    import numpy as np

    f = token_features(words, memo)
    at = lambda place: sum(w[f[:, column]] for p, column in VIEWS if p == place)
    e = at(0)[codes]
    n = np.diff(offsets)
    first, last = offsets[:-1][n > 0], offsets[1:][n > 0] - 1
    left, right = at(-1)[codes], at(1)[codes]
    e[1:] += left[:-1]
    e[:-1] += right[1:]
    e[first[1:]] -= left[first[1:] - 1]
    e[last[:-1]] -= right[last[:-1] + 1]
    return e + np.repeat(file_features(codes, offsets, f[:, 7:]) @ w_file, n, axis=0)


def file_features(codes, offsets, marks):
    """Rows of (1, share of tokens with digits, share of long tokens, few tokens); marks: digit and long by distinct word."""
    import numpy as np

    n = np.diff(offsets)
    sums = [np.diff(np.concatenate([[0], np.cumsum(m[codes])])[offsets]) if len(codes) else n * 0 for m in marks.T]
    return np.stack([np.ones(len(n)), sums[0] / np.maximum(1, n), sums[1] / np.maximum(1, n), n < 20], 1).astype(np.float32)


def viterbi(e, t):
    """Best labels of one chain with emissions e (n, 3) and transitions t (3, 3)."""
    import numpy as np

    best, back = e[0], []
    for x in e[1:]:
        s = best[:, None] + t
        k = s.argmax(0)
        back.append(k)
        best = s[k, (0, 1, 2)] + x
    path = [int(np.argmax(best))]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    return path[::-1]


def decode(e, offsets, t):
    """Best labels of all chains: stretches between tokens that are outside in any best path."""
    import numpy as np

    # changing one label to "outside" changes two transitions at most
    spread = (t.max(0) - t.min(0)).max() + (t.max(1) - t.min(1)).max()
    open_ = np.flatnonzero(e[:, OUT] - e[:, 1:].max(1) <= spread)
    labels = np.zeros(len(e), np.int8)
    if not len(open_):
        return labels
    row, starts = np.searchsorted(offsets, open_, "right"), set(offsets.tolist())
    cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(row) > 0)) + 1
    for group in np.split(open_, cuts):
        a, b = group[0], group[-1] + 1
        lo = a - 1 if int(a) not in starts else a  # the neighbours outside the stretch are OUT
        hi = b + 1 if int(b) not in starts and b < len(e) else b
        x = e[lo:hi].copy()
        if lo < a:
            x[0, 1:] = -1e9
        if hi > b:
            x[-1, 1:] = -1e9
        labels[a:b] = viterbi(x, t)[a - lo : a - lo + (b - a)]
    return labels


def gradients(e, gold, real, t):
    """Gradients of the log likelihood of chains of one length (n, length, 3): for emissions and transitions.

    real marks the tokens that are there; the padding behind them counts for nothing.
    """
    import numpy as np

    def lse(x, axis):
        m = x.max(axis)
        return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))

    n, length, _ = e.shape
    f, b = np.empty_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for i in range(1, length):
        step = lse(f[:, i - 1, :, None] + t, 1) + e[:, i]
        f[:, i] = np.where(real[:, i, None], step, f[:, i - 1])
    for i in range(length - 2, -1, -1):
        step = lse(t[None] + (e[:, i + 1] + b[:, i + 1])[:, None], 2)
        b[:, i] = np.where(real[:, i + 1, None], step, 0)
    z = lse(f[:, -1], 1)[:, None]
    ge = -np.exp(f + b - z[:, None]) * real[:, :, None]
    np.put_along_axis(ge, gold[:, :, None], np.take_along_axis(ge, gold[:, :, None], 2) + real[:, :, None], 2)
    gt = np.zeros((3, 3))
    for i in range(1, length):
        both = np.exp(f[:, i - 1, :, None] + t[None] + (e[:, i] + b[:, i])[:, None] - z[:, None]) * real[:, i, None, None]
        gt -= both.sum(0)
        np.add.at(gt, (gold[real[:, i], i - 1], gold[real[:, i], i]), 1)
    return ge, gt


def fit(windows, epochs=EPOCHS, rate=0.5, batch=32):
    """Weights (w, w_file, t) from windows (words, labels, file features) by adaptive gradient steps."""
    import numpy as np

    w, w_file, t = np.zeros((SIZE, 3)), np.zeros((4, 3)), np.zeros((3, 3))
    sw, sf, st = np.full_like(w, 1e-2), np.full_like(w_file, 1e-2), np.full_like(t, 1e-2)
    n, length, memo = len(windows), max(len(x[0]) for x in windows), {}
    feats, gold, real = np.zeros((n, length, 7), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (words, labels, _) in enumerate(windows):
        feats[i, : len(words)] = token_features(words, memo)[:, :7]
        gold[i, : len(words)] = labels
        real[i, : len(words)] = True
    files = np.array([x[2] for x in windows], np.float64)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(n)
        for at in range(0, n, batch):
            some = order[at : at + batch]
            x, m, file = feats[some], real[some], files[some]
            e = np.repeat((file @ w_file)[:, None], length, 1)
            rows, spots = [], []
            for shift, column in VIEWS:
                here = m & np.roll(m, -shift, 1)
                here[:, -1 if shift > 0 else 0] &= shift == 0
                value = np.roll(x[:, :, column], -shift, 1)
                e += np.where(here[:, :, None], w[value], 0)
                rows.append(value[here])
                spots.append(np.flatnonzero(here.reshape(-1)))
            ge, gt = gradients(e, gold[some], m, t)
            rows, flat = np.concatenate(rows), ge.reshape(-1, 3)[np.concatenate(spots)]
            used, back = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(back, flat[:, c], len(used)) for c in range(3)], 1) - 1e-3 * w[used]
            sw[used] += g * g
            w[used] += rate * g / np.sqrt(sw[used])
            gf = file.T @ ge.sum(1)
            sf += gf * gf
            w_file += 0.1 * rate * gf / np.sqrt(sf)
            st += gt * gt
            t += 0.1 * rate * gt / np.sqrt(st)
    return w.astype(np.float32), w_file.astype(np.float32), t.astype(np.float32)


def token_places(text):
    """Starts and ends of the tokens of a text, as the words of ``ascii_words``."""
    return [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CUES = "key auth credential credentials pass pwd passphrase pin bearer access private signing login session client webhook encryption master".split()


def examples(rng, plain):
    """Tokens and labels of a made-up secret, or of a harmless look-alike (all outside). plain: words to build it with.

    Secrets: random strings of many alphabets and lengths, bare, quoted, behind a prefix, in dotted parts, in addresses, and
    behind cues in the ways that texts and settings write them. Look-alikes: addresses, dates, versions, paths, names, settings.
    """
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    any_word = lambda: re.sub(r"[^A-Za-z]", "", rng.choice(plain)) or "name"
    if rng.random() < 0.5:
        w, v, u = any_word(), any_word(), any_word()
        number = str(rng.randrange(10 ** rng.randrange(1, 12)))
        marks = rng.choice("*%&$#!~^=_+|") * rng.randrange(1, 5)
        own = rng.choice(plain).strip("*%&$#!~^=_+|") or "name"
        made = rng.choice([
            f"{own}{marks}", f"{own}.{marks}", f"{w}.{marks}", f"{own},{marks}", f"{w}{v}.{marks}", f"{w.title()}{v}{u}{marks}", f"{marks}{own}{marks}", f"{own.upper()}{marks}", f"{number}{marks}",
            f"https://{w}.example/{v}/{number}.html", f"https://{w}.{v}.example/{u}/{w.title()}-{v}/{u}_{w}?q={v}", f"https://{w}.example/{number}/{v}/{u}/{number}", f"http://www.{w}.org/{v}-{u}?id={number}", f"{w}.{v}@{u}.example", f"{w}@{v}.org,", f"20{run(DIGITS, 2)}-0{run('123456789', 1)}-1{run(DIGITS, 1)}T1{run(DIGITS, 1)}:2{run(DIGITS, 1)}:00Z",
            f"v{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(30)}-{w}", f"/usr/{w}/{v}/{u}.txt", f"{w}_{v}_{u}", f"{w}-{v}-{u}-{w}", f"{w}{v.title()}{u.title()}", f"{w}={v}", f"{w}: {v}", f'"{w}": "{v}"', f"{w}: {number}", f"{w}={number}",
            f"{w.upper()}_{v.upper()}", f"+{run(DIGITS, 2)} {run(DIGITS, 3)} {run(DIGITS, 4)}", f"{run(DIGITS, 4)} {run(DIGITS, 4)} {run(DIGITS, 4)} {run(DIGITS, 4)}", f"{run(UPPER, 2)}-{run(DIGITS, 4)}", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}:{number[:4]}",
            f"{run(LOWER + DIGITS, 7)}", f"{w}({v}, {u})", "-" * rng.randrange(3, 40), f"{(w + v + u) * 2}", f"{w}!!!{v}***{u}###", f"{rng.choice(CUES)} {w} {v}", f"the {rng.choice(CUES)} of {w}", f"{w}.{v}.{u}.{w}", f"postgres://{w}.{v}:5432/{u}",
        ])
        tokens = made.split()
        return tokens, [OUT] * len(tokens)
    letters = rng.choice([LOWER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "_-", UPPER + DIGITS, "ABCDEF" + DIGITS])
    cue, way = rng.choice(CUES), rng.random()
    prefix = "".join(run(LOWER + DIGITS[1:4] * (k > 0), rng.randrange(2, 6)) + rng.choice("_-") for k in range(rng.choice([1, 1, 2]))) if rng.random() < 0.35 else ""
    value = prefix + run(letters, rng.choice([rng.randrange(18, 30), rng.randrange(20, 70), rng.randrange(50, 95)])) + rng.choice(["", "", "", "=", "=="])
    if way < 0.2:
        before, made, after = [], value, []
    elif way < 0.35:
        parts = [run(LOWER + UPPER + DIGITS + "_-", rng.randrange(15, 70)) for _ in range(rng.choice([2, 3, 3]))]
        before, made, after = [], ".".join([*([run(LOWER, rng.randrange(2, 4)) + run(DIGITS, 2)] if rng.random() < 0.3 else []), *parts[rng.random() < 0.3 :]]), []
    elif way < 0.42:  # an address that is a secret by its last parts
        parts = [run(rng.choice([UPPER + DIGITS, LOWER + UPPER + DIGITS]), rng.randrange(8, 44)) for _ in range(rng.randrange(1, 4))]
        before, made, after = [], f"https://{any_word()}.{any_word()}.example/{any_word()}/{'/'.join([*parts[:-1], parts[-1] + run(LOWER + UPPER + DIGITS, 16)])}", []
    elif way < 0.55:
        secret = run(LOWER + UPPER + DIGITS + "!$%&*#", rng.randrange(6, 20))
        before, made, after = [], f"{rng.choice(['mysql', 'amqp', 'redis', 'ftp', 'https', 'mongodb'])}://{any_word()}:{secret}@{any_word()}.example:{rng.randrange(9999)}/{any_word()}", []
    else:
        if rng.random() < 0.4:
            value = run(LOWER + UPPER + DIGITS + "!$%&*#", rng.randrange(8, 20))
        mark = rng.choice(["", "'", '"'])
        value, name = f"{mark}{value}{mark}", rng.choice([cue, cue.upper(), f"{any_word()}_{cue}", f"{any_word()}-{cue}", f"{any_word().upper()}_{cue.upper()}", f"{any_word().title()}{cue.title()}", f"{any_word().title()}{cue.title()}"])
        before, made, after = rng.choice([([name, "="], value, []), ([f"{name}:"], value, []), ([f'"{name}":'], value + ",", []), ([], f"{name}={value}", []), ([name, "is"], value, []), ([f"--{name}"], value, []), (["Authorization:", "Bearer"], value, []), ([name], value, [])])
    return [*before, made, *after], [OUT] * len(before) + [BEGIN] + [OUT] * len(after)


#: Windows that one document of the sample gives at most, by base matches and by made-up examples.
WINDOWS, MADE = 20, 3


def training_windows(text, seed, side):
    """Windows (words, labels, file features) of one text."""
    import random

    import numpy as np

    places = token_places(text)
    if not places:
        return []
    words, rng = [text[a:b] for a, b in places], random.Random(seed)
    file = file_features(np.arange(len(words)), np.array([0, len(words)]), token_features(words)[:, 7:])[0].tolist()
    gold, touched = [OUT] * len(words), []
    ends = np.array([b for _, b in places])
    for a, _, b in base_spans(text):
        first = i = int(np.searchsorted(ends, a, "right"))
        while i < len(places) and places[i][0] < b:
            if gold[i] == OUT:
                gold[i] = BEGIN if i == first else IN
            touched.append(i)
            i += 1
    found = []
    for i in touched[:WINDOWS] or [rng.randrange(len(words)) for _ in range(2)]:
        found.append((words[max(0, i - side) : i + side + 1], gold[max(0, i - side) : i + side + 1], file))
    for _ in range(MADE):
        i = rng.randrange(len(words) + 1)
        tokens, labels = examples(rng, words)
        a, b = max(0, i - side), i + side
        found.append(([*words[a:i], *tokens, *words[i:b]], [*gold[a:i], *labels, *gold[i:b]], file))
    return found


def train(docs, max_docs=MAX_DOCS, epochs=EPOCHS, side=8):
    """Weights from windows of at most max_docs documents, up to half of them with base matches, or None without any text.

    The documents are those with the smallest hashes of their text among the first ``LOOKED_AT * max_docs`` of them; a window
    reaches ``side`` tokens to both sides. The windows meet in one task, which returns the weights.
    """
    import pickle

    text = F.coalesce("text", F.lit(""))
    ids = docs.select(F.xxhash64(text).alias("h")).filter(F.col("h") != F.xxhash64(F.lit("")))
    looked = least_hashes(ids, "h", LOOKED_AT * max_docs).distinct()  # a bounded number of 8-byte hashes
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(looked), "h").dropDuplicates(["h"])
    rows = rows.select("text", rows["text"].rlike(ASSIGN.replace("(?ai)", "(?i)")).alias("assign"), "h")
    rows = rows.withColumn("hit", F.col("assign") | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [w for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()) for w in training_windows(text, h, side)]
            ws, gs, fs = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.list_(pa.string())), pa.array(gs, pa.list_(pa.int32())), pa.array(fs, pa.list_(pa.float32()))], ["w", "g", "f"])

    def fitted(batches):
        import pyarrow as pa

        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["w"], r["g"]))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(r["w"], r["g"], r["f"]) for r in got], epochs))], pa.binary())], ["weights"])

    rows = materialize(rows.select("text", "h", "hit"), "training-texts")
    best = [least_hashes(rows.filter(F.col("hit") == hit).select("h"), "h", max_docs // 2) for hit in (True, False)]  # bounded as well
    windows = rows.join(F.broadcast(best[0].union(best[1])), "h").select("text", "h").mapInArrow(run, "w array<string>, g array<int>, f array<float>")
    got = windows.repartition(1).mapInArrow(fitted, "weights binary").first()
    return pickle.loads(got["weights"]) if got else None


def trim(text, a, b):
    """The span without the quotes, brackets and commas around it."""
    around = "\"'`,;()[]{}<>"
    while a < b and text[a] in around:
        a += 1
    while a < b and text[b - 1] in around:
        b -= 1
    return a, b


def scan(docs, weights=None):
    """Per row of docs(doc_id, text): doc_id, spans: array of (kind, start, end), code points, base spans and spans of the field."""
    shared = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else train(docs))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memo = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [base_spans(t) for t in texts]
                added = [[] for _ in texts]
                if shared.value is not None:
                    w, w_file, t = shared.value
                    codes, offsets, vocabulary = ascii_words(part.column("text"))
                    e = emissions(codes, offsets, vocabulary.to_pylist(), w, w_file, memo)
                    labels = decode(e, offsets, t)
                    hits = np.flatnonzero(labels)
                    rows = np.searchsorted(offsets, hits, "right") - 1
                    for r in np.unique(rows):
                        places = token_places(texts[r])
                        spans = []
                        for i in hits[rows == r] - offsets[r]:
                            a, b = places[i]
                            if labels[offsets[r] + i] == IN and spans and spans[-1][3] == i - 1:
                                spans[-1][1:] = b, spans[-1][2], i
                            else:
                                spans.append([a, b, i, i])
                        trimmed = [trim(texts[r], s[0], s[1]) for s in spans]
                        added[r] = [(a, 3, b) for a, b in trimmed if b - a >= LEAST and not any(x < b and a < y for x, _, y in found[r])]
                names = (*KINDS, "crf")
                out = [[{"kind": names[k], "start": a, "end": b} for a, k, b in sorted(f + g)] for f, g in zip(found, added)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_crf(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op4_secret_crf": op4_secret_crf}
ORACLE_SQL = {}
