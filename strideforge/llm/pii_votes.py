"""Personal data in texts: fixed patterns, and spans that weak labelers vote for, weighed by expectation-maximisation.

Base patterns (each leftmost and non-overlapping, by kind): email, ip, card, phone, as the contract of ``op12_pii_votes`` gives them.
They always stay.

Candidates are the base spans and whatever looks like personal data at all: long numbers (phone, card, ssn, birth for dates), IBANs
(iban), colon-separated addresses (ipv6, mac), written-out mail addresses (email), names behind titles and cues (person), streets
with numbers (address). ``LABELERS`` vote on each: regular expressions (form, base), arithmetic (checksum, range), a gazetteer
(top-level domains, calling codes, issuers, countries, given names, street words), and context (cue words, counter-cues, what the
span is embedded in, numbers around it); a labeler abstains on kinds that it knows nothing about. No labels exist: the reliabilities
of each labeler on personal and on other spans, and the share of personal ones by kind, are estimated by expectation-maximisation
over the counts of all votes of the whole corpus. Their posterior is the target of the final classifier, a logistic regression on
the votes, the span's shape and the words around it, trained on at most ``max_spans`` candidates. A candidate of ``threshold`` or
more that no base span overlaps is added under its kind; of overlapping ones the earlier, then longer one.

Texts are scanned once: the candidates with their votes and features are written, and all later steps read those. What the driver
sees is one row for each combination of kind and votes (fewer than ``len(KINDS) * 3 ** len(LABELERS)``, in practice hundreds).

Null and empty texts have no spans, texts of any length are scanned whole, in time linear in their length. Repeated rows are scanned
alike; null ids stay null; an empty table gives no rows and trains nothing. Other columns are ignored.
"""

import itertools
import pickle
import re

from pyspark.sql import functions as F

from strideforge.llm.common import least_hashes, materialize, slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "birth", "iban", "ipv6", "mac", "person", "address")
LABELERS = ("base", "form", "checksum", "range", "gazetteer", "cue", "counter", "embedded", "crowd")
MAX_SPANS, THRESHOLD, SIZE = 20_000, 0.9, 1 << 14

# Fixed patterns of the base kinds, each in a form that takes linear time.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
THREE_PARTS = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [2 * int(d) for d in number[-2::-2]]
    return not (sum(map(int, number[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10


def mails(text):
    """Spans of mail addresses: at each @ the run of local characters before it and the domain behind it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text):
    """Spans of four numbers with dots between them."""
    found, free = [], 0
    m = THREE_PARTS.search(text)
    while m:
        a = m.start()
        while a > free and "0" <= text[a - 1] <= "9":
            a -= 1
        if a < m.start():
            found.append((a, m.end()))
            free = m.end()
        m = THREE_PARTS.search(text, max(free, m.start() + 1))
    return found


def base_spans(text):
    """(start, kind number, end) of the base patterns in order."""
    found = [(a, 0, b) for a, b in mails(text)]
    for a, b in addresses(text):
        if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in text[a:b].split("."))):
            found.append((a, 1, b))
    for m in CARD.finditer(text):
        n = digits(m[0])
        if len(n) <= 19 and luhn(n):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


# Candidates beside the base spans.
NUMBER = re.compile(r"[0-9(][0-9\x20().\-/]{6,}")
COLONS = re.compile(r":(?:[0-9A-Fa-f]{0,4}:){2,}+[0-9A-Fa-f]{0,4}")
DASHED = re.compile(r"-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-")
SIX_PAIRS = re.compile(r"[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z-])")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z]{0,3}[0-9][A-Z0-9]{0,2})?)(?![0-9A-Za-z])")
WRITTEN = re.compile(r"[\[({<]\s?(?:at|AT|dot|DOT)\s?[\])}>]|\sdot\s")
WRITTEN_MAIL = re.compile(
    r"[A-Za-z0-9._+-]{2,40}\s?(?:[\[({<]\s?at\s?[\])}>]|\sat\s)\s?[A-Za-z0-9-]{2,40}(?:\s?(?:[\[({<]\s?dot\s?[\])}>]|\sdot\s|\.)\s?[A-Za-z0-9-]{2,20}){1,3}", re.I
)
NAMES = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]{1,24}+(?:\x20(?:[A-Z]\.\x20)?(?:von\x20|de\x20|del\x20|van\x20|du\x20)?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]{1,24}+){0,3}")
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Herrn Frau Monsieur Madame Mme Señor Señora Sr Sra Dear Liebe Lieber Cher Chère Name Contact Signed Patient Nom Nombre".split())
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd Court Ct Square Way Terrace Close".split()
NUMBER_FIRST = re.compile(rf"[0-9]{{1,5}}[a-z]?,?\x20(?:(?:[A-Z][a-z]{{1,20}}\x20){{1,3}}(?:{'|'.join(STREETS)})\b|(?:rue|avenue|boulevard|place|allée)\x20(?:de\x20la\x20|de\x20|du\x20|des\x20)?[A-ZÀ-Þ][a-zß-ÿ-]{{2,24}})")
STREET_FIRST = re.compile(r"(?:\b[A-ZÄÖÜ][a-zäöüß-]{1,24}(?:straße|strasse|gasse|platz|weg|allee)|\b(?:Calle|Avenida|Plaza|Via|Paseo)\x20(?:de\x20|del\x20|la\x20)*[A-ZÀ-Þ][a-zß-ÿ]{2,24},?)\x20\Z")
DIGITS = re.compile(r"[0-9]++")
DATE = re.compile(r"([0-9]{1,4})([./-])([0-9]{1,2})\2([0-9]{1,4})")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
LOCAL_PHONE = re.compile(r"(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}")


def numbers(text):
    """(start, kind, end) of numbers that may be a card, social security number, date or phone."""
    for m in NUMBER.finditer(text):
        whole = m[0]
        value = whole.rstrip(" .(/-)") if whole.count("(") != whole.count(")") or whole[-1:] != ")" else whole.rstrip(" .(/-")
        if not 7 <= len(value) <= 30:
            continue
        a, b, n = m.start(), m.start() + len(value), len(digits(value))
        if SSN.fullmatch(value):
            yield a, "ssn", b
        elif DATE.fullmatch(value):
            yield a, "birth", b
        elif 14 <= n <= 19 and not set(value) & set("()./"):
            yield a, "card", b
        elif LOCAL_PHONE.fullmatch(value) and 7 <= n <= 15:
            yield a, "phone", b


def colons(text):
    """(start, kind, end) of hexadecimal groups with three colons or more."""
    for m in COLONS.finditer(text):
        a = m.start()
        while a > 0 and m.start() - a < 4 and text[a - 1] in "0123456789abcdefABCDEF":
            a -= 1
        yield a, "mac" if m.end() - a == 17 and m[0].count(":") == 5 else "ipv6", m.end()
    for m in DASHED.finditer(text):
        p = SIX_PAIRS.match(text, m.start() - 2) if m.start() >= 2 else None
        if p and not text[max(0, p.start() - 1) : p.start()].isalnum():
            yield p.start(), "mac", p.end()


def written_mails(text):
    """(start, kind, end) of mail addresses that are written out."""
    last = 0
    for m in WRITTEN.finditer(text):
        for w in WRITTEN_MAIL.finditer(text, max(last, m.start() - 60), min(len(text), m.end() + 80)):
            if w.start() <= m.start() < w.end():
                yield w.start(), "email", w.end()
                last = w.end()


def names(text):
    """(start, kind, end) of capitalised words behind a title or cue, or of two that begin with a given name."""
    for m in NAMES.finditer(text):
        first, _, rest = m[0].partition(" ")
        if first in TITLES:
            if rest:
                yield m.end() - len(rest), "person", m.end()
        elif rest and first in GIVEN:
            yield m.start(), "person", m.end()
        elif text[max(0, m.start() - 1) : m.start()] == " ":
            before = WORD.findall(text[max(0, m.start() - 12) : m.start()])[-2:]
            if before and (before[-1] in TITLES or rest and (before[-1].lower() in CUES["person"] or before[-1] == "is" and before[0] == "name")):
                yield m.start(), "person", m.end()


def houses(text):
    """(start, kind, end) of streets with a number before or behind them."""
    for m in DIGITS.finditer(text):
        a, b = m.span()
        if b - a > 5:
            continue
        h = NUMBER_FIRST.match(text, a)
        if h:
            yield a, "address", h.end()
        elif text[max(0, a - 1) : a] == " " and b - a < 5:
            h = STREET_FIRST.search(text[max(0, a - 50) : a])
            if h:
                yield a - len(h[0]), "address", b


def candidates(text, base):
    """(start, kind, end): base spans, and between them all other candidates; those do not overlap each other."""
    found = [*numbers(text), *written_mails(text), *names(text), *houses(text)]
    if ":" in text or "-" in text:
        found += colons(text)
    found += [(m.start(), "iban", m.end()) for m in ACCOUNT.finditer(text) if not text[max(0, m.start() - 1) : m.start()].isalnum()]
    taken, out, free, i = [], [], 0, 0
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    for a, kind, b in sorted(found, key=lambda c: (c[0], -c[2], c[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= free and not (i < len(taken) and taken[i][0] < b):
            out.append((a, kind, b))
            free = b
    return sorted([(a, BASE[k], b) for a, k, b in base] + out, key=lambda c: (c[0], KINDS.index(c[1]), c[2]))


# Gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co me tv app dev ai eu de at ch fr be nl lu uk ie es pt it gr pl cz sk hu ro bg se no dk fi is ee lv lt us ca mx br ar cl pe jp kr cn tw in au nz za ru ua tr il".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 255 256 351 352 353 354 356 357 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 965 966 971 972 974".split())
#: Countries of IBANs with the length of their numbers.
IBANS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
GIVEN = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia George Oliver Jack Alice Grace Peter Paul Mark Andrew Daniel Laura Anna Maria Julia Sophie "
    "Hans Karl Klaus Jürgen Wolfgang Heinz Stefan Andreas Markus Lukas Felix Jonas Ursula Monika Petra Sabine Renate Katharina Lena Hannah Greta Heike Birgit Jean Pierre Michel Philippe Alain Nicolas Luc Louis Antoine Camille Marie Claire Hélène Isabelle Nathalie "
    "Céline Chloé Léa Manon José Juan Antonio Manuel Francisco Carlos Miguel Javier Luis Pedro Pablo Diego Carmen Ana Isabel Lucía Marta Elena Rosa Sofía Pilar".split()
)
CUES = {
    "email": "mail email e-mail contact write correo courriel adresse reach", "ip": "ip address host server addr from client login adresse",
    "card": "card visa mastercard amex credit debit karte tarjeta carte payment", "phone": "phone call tel telephone mobile cell fax contact telefon ruf llame appelez móvil handy whatsapp dial number",
    "ssn": "ssn social security taxpayer", "birth": "born birth dob birthday geboren geburtsdatum né née nacido nacida nacimiento naissance", "iban": "iban account konto bank transfer cuenta compte überweisung",
    "ipv6": "ip ipv6 address host addr client", "mac": "mac hardware device ethernet address wifi", "person": "mr mrs ms dr prof name herr herrn frau monsieur madame mme señor señora sr sra contact signed patient dear llamo heiße appelle",
    "address": "address live lives lived home street wohnhaft wohnt adresse anschrift habite domicilio vive reside resides located",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
COUNTER = frozenset("version ver v release build isbn issn doi order invoice ticket item sku part model serial page pages section chapter figure table row id ref reference price total sum amount eur usd score ratio lot batch case rfc standard article number-of updated published".split())
WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*", re.U)


def sides(text, a, b):
    """Up to five words before a span and three behind it, in lower case."""
    left, right = text[max(0, a - 60) : a], text[b : b + 40]
    return [w.lower() for w in WORD.findall(left)[-5:]], [w.lower() for w in WORD.findall(right)[:3]]


def good_date(value):
    m = DATE.fullmatch(value)
    x, y, z = int(m[1]), int(m[3]), int(m[4])
    year, first, second = (x, y, z) if len(m[1]) == 4 else (z, x, y)
    return 1900 <= year <= 2030 and min(first, second) in range(1, 13) and max(first, second) <= 31


def mod97(value):
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def votes(text, a, kind, b, is_base, left, right):
    """One letter for each of LABELERS: + personal, - not, 0 abstains."""
    value = text[a:b]
    n = digits(value)
    form, check, reach, known = "0", "0", "0", "0"
    if kind == "email":
        end = re.split(r"[^A-Za-z0-9]+", value)[-1].lower()
        form, known = "+" if len(value) <= 80 and value[0].isalnum() else "-", "+" if end in DOMAINS else "-"
    elif kind == "ip":
        form, reach = "+" if len(n) >= 6 else "-", "+" if value.split(".")[0].strip("0") and len(n) >= 5 else "-"
    elif kind == "card":
        check, form = "+" if luhn(n) else "-", "+" if len(n) in (14, 15, 16) else "-"
        known, reach = "+" if n[0] in "3456" else "-", "+" if len(set(n)) > 3 else "-"
    elif kind == "phone":
        plus = value[0] == "+" or n[:2] == "00"
        code = n.removeprefix("00")
        known = ("+" if any(code[:i] in CALLING for i in (1, 2, 3)) else "-") if plus else "0"
        form = "+" if plus or re.fullmatch(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ /-][0-9 -]{5,}|0[1-9](?:[ .][0-9]{2}){4}", value) else "-"
        reach = "+" if 9 <= len(n) <= 15 and len(set(n)) > 2 else "-"
    elif kind == "ssn":
        form, reach = "+", "+" if value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[-4:] != "0000" else "-"
    elif kind == "birth":
        reach, form = "+" if good_date(value) else "-", "+" if left and left[-1] in CUES["birth"] or len(left) > 1 and left[-2] in CUES["birth"] else "-"
    elif kind == "iban":
        bare = value.replace(" ", "")
        check, known, form = "+" if mod97(value) else "-", "+" if IBANS.get(bare[:2]) == len(bare) else "-", "+" if re.fullmatch(r"\w+|\w{4}(?: \w{4})*(?: \w{1,4})?", value) else "-"
    elif kind == "ipv6":
        form, reach = "+" if value.count("::") == 1 or value.count(":") == 7 and "::" not in value else "-", "+" if len(value) >= 11 else "-"
    elif kind == "mac":
        form, reach = "+", "+" if len(set(value)) > 4 else "-"
    elif kind == "person":
        words = value.split(" ")
        known, form = "+" if words[0] in GIVEN else "-", "+" if len(words) > 1 else "-"
    elif kind == "address":
        form, known = "+" if len(value.split(" ")) > 1 else "-", "+" if any(w.strip(".,") in STREETS for w in value.split(" ")) or re.search("(?:straße|strasse|gasse|platz|weg|allee|rue|Calle|Avenida|Plaza|avenue|boulevard)", value) else "-"
    base = ("+" if is_base else "-") if kind in BASE and not (kind in ("email", "phone") and not is_base) else "0"
    cue = "+" if CUES[kind].intersection(left) or CUES[kind].intersection(right[:2]) else "-"
    counter = "-" if COUNTER.intersection(left[-3:]) or text[max(0, a - 2) : a].strip()[-1:] in ("$", "€", "£", "#") or text[b : b + 2].strip()[:1] in ("%", "€") else "+"
    before, after = text[max(0, a - 1) : a], text[b : b + 2]
    embedded = "-" if before.isalnum() or before in ("_", "/", "=", "&", "~", "-") and before or after[:1].isalnum() or after[:1] in ("_", "/", "=", "-") and after[:1] else "+"
    near = left[-3:] + right
    crowd = "-" if sum(any(c.isdigit() for c in w) for w in near) >= 3 else "+"
    return "".join((base, form, check, reach, known, cue, counter, embedded, crowd))


def features(text, a, kind, b, vote, left, right):
    """Hashed features of a candidate: votes (as they are and by kind), shape, length, words around."""
    import xxhash

    shape = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text[a : min(b, a + 40)]))
    names = ["bias", f"kind {kind}", f"shape {kind} {shape}", f"size {kind} {(b - a).bit_length()}"]
    names += [f"vote {m} {v}" for m, v in zip(LABELERS, vote) if v != "0"] + [f"vote {kind} {m} {v}" for m, v in zip(LABELERS, vote) if v != "0"]
    names += [f"before {kind} {w}" for w in left[-2:]] + [f"after {kind} {w}" for w in right[:1]]
    return [xxhash.xxh3_64_intdigest(x) % SIZE for x in names]


SEEN = "struct<start:long,end:long,kind:string,base:boolean,votes:string,features:array<int>>"


def look(docs):
    """Per row of docs(doc_id, text): doc_id, seen: its candidates with their votes and features."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    fixed = {(a, BASE[k], b) for a, k, b in base}
                    seen = []
                    for a, k, b in candidates(text, base):
                        left, right = sides(text, a, b)
                        vote = votes(text, a, k, b, (a, k, b) in fixed, left, right)
                        seen.append({"start": a, "end": b, "kind": k, "base": (a, k, b) in fixed, "votes": vote, "features": features(text, a, k, b, vote, left, right)})
                    out.append(seen)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "seen"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, seen array<{SEEN}>")


#: Votes that a labeler is taken to have cast before the first one: personal and other spans, for and against.
PRIOR = ((8.0, 4.0), (4.0, 8.0))


def reliabilities(counts, rounds=200, tolerance=1e-9):
    """Expectation-maximisation over counts {(kind, votes): number}: (share by kind, odds (labelers, 2), posterior by (kind, votes)).

    odds[m] is the chance that labeler m votes for a span that is personal, and for one that is not, where it votes at all. An
    abstention says nothing. The first posterior is the share of votes for a span.
    """
    import numpy as np

    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([[{"+": 1, "-": -1}.get(x, 0) for x in k[1]] for k in keys])
    kinds = sorted({k for k, _ in keys})
    at = np.array([kinds.index(k) for k, _ in keys])
    y = ((v > 0).sum(1) + 0.5) / ((v != 0).sum(1) + 1)
    for _ in range(rounds):
        share = (np.bincount(at, n * y, len(kinds)) + 1) / (np.bincount(at, n, len(kinds)) + 2)
        odds = np.empty((v.shape[1], 2))
        for c, w in enumerate((n * y, n * (1 - y))):
            yes, no = w @ (v > 0), w @ (v < 0)
            odds[:, c] = (yes + PRIOR[c][0]) / (yes + no + sum(PRIOR[c]))
        told = (v > 0) @ np.log(odds[:, 0] / odds[:, 1]) + (v < 0) @ np.log((1 - odds[:, 0]) / (1 - odds[:, 1]))
        new = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share))[at] + told, -40, 40)))
        done = np.abs(new - y).max() < tolerance
        y = new
        if done:
            break
    return dict(zip(kinds, share)), odds, dict(zip(keys, y))


def fit(rows, targets, weights, epochs=20, rate=0.3, decay=1e-3):
    """Weights (SIZE,) of a logistic regression on hashed features by adaptive gradient steps towards soft targets."""
    import numpy as np

    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-2)
    flat, sizes = np.concatenate([np.asarray(r) for r in rows]), np.array([len(r) for r in rows])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for some in np.array_split(order, max(1, len(order) // 64)):
            take = np.concatenate([flat[ends[i] : ends[i + 1]] for i in some])
            row = np.repeat(np.arange(len(some)), sizes[some])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[take], len(some)), -40, 40)))
            g = (p - targets[some]) * weights[some]
            used, back = np.unique(take, return_inverse=True)
            step = np.bincount(back, g[row], len(used)) / len(some) + decay * w[used]
            seen[used] += step * step
            w[used] -= rate * step / np.sqrt(seen[used])
    return w


def train(seen, max_spans=MAX_SPANS):
    """Weights of the final classifier from the candidates of ``look``, or None if there are none.

    Its rows are the candidates with the smallest hashes, at most max_spans of them; equal ones count by their number. The fit runs in
    one task.
    """
    each = seen.select(F.explode("seen").alias("s")).select("s.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    posterior = {f"{k} {v}": float(y) for (k, v), y in reliabilities(counts)[2].items()}
    same = each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    rows = least_hashes(same.withColumn("h", F.xxhash64("kind", "votes", F.to_json("features"))), "h", max_spans)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        got = sorted((r["h"], r["features"], f"{r['kind']} {r['votes']}", r["n"]) for b in batches for r in b.to_pylist())
        if got:
            y, n = np.array([posterior[r[2]] for r in got]), np.array([r[3] for r in got], float)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in got], y, np.sqrt(n) / np.sqrt(n).mean()))], pa.binary())], ["weights"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "weights binary").first()["weights"])


def choose(seen, weights, threshold=THRESHOLD):
    """seen with spans instead: array of (kind, start, end), base spans and those that the classifier adds."""
    shared = seen.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        least = np.log(threshold / (1 - threshold))
        for batch in batches:
            out = []
            for row in batch.column("seen").to_pylist():
                kept = [s for s in row if s["base"] or shared.value is not None and shared.value[s["features"]].sum() >= least]
                out.append([{"kind": s["kind"], "start": s["start"], "end": s["end"]} for s in sorted(kept, key=lambda s: (s["start"], KINDS.index(s["kind"])))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind), batch.column("seen")], ["doc_id", "spans", "seen"])

    return seen.mapInArrow(run, f"doc_id long, spans array<struct<kind:string,start:long,end:long>>, seen array<{SEEN}>")


def scan(docs, weights=None, threshold=THRESHOLD):
    """Per row of docs(doc_id, text): doc_id, spans: array of (kind, start, end), code points; seen: all candidates with their votes.

    weights: of ``train``; without them they are trained on docs.
    """
    seen = materialize(look(docs), "candidates")
    return choose(seen, train(seen) if weights is None else weights, threshold)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii_votes(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("seen", lambda s: s["base"])
    count = lambda k: F.size(F.filter("seen", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op12_pii_votes": op12_pii_votes}
ORACLE_SQL = {}
