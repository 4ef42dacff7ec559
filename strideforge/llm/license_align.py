"""License texts and notices in documents, by patience alignment with templates.

A template and a stretch of a document are aligned by anchors: words that occur once in both, of which the longest chain in
the order of both is kept; the gaps between the anchors are aligned in the same way, and equal words at the ends of a gap
are taken first. Coverage is the aligned share of the template's words. A license is found where coverage reaches
``coverage`` and the aligned words lie dense (at most ``spread`` times the template's length).

Every word of every document is looked up in the templates' words. A stretch is a candidate for a template only around an
occurrence of one of its key words and if enough of its distinct words occur there: a place with the needed coverage must
hold at least that share of the template's words, so the test loses none. Templates are constants of this module or a
parameter; their number is checked, as they travel with the code.

Short forms (``short_forms``: names of the Creative Commons licenses with and without versions, SPDX lines, and one-line
notices that differ from each other in a word or two) must stand word for word, so that none stands for another.

Words are runs of letters and digits in lower case. Null and empty texts hold no license, an empty table gives no finds, texts of
any length are scanned whole. Overlapping finds of one document
give the best: most aligned words, then coverage, then the template's name. Repeated rows are scanned alike; null ids stay
null; other columns are ignored.
"""

from pyspark.sql import functions as F

from strideforge.llm.common import slices, table

# Fixed texts: public notices and headers of common licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0-notice": "Licensed under the GNU General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Further headers and notices, aligned by coverage as the ones above.
TEMPLATES |= {
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Lesser General"),
    "AGPL-3.0": TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Affero General"),
    "GPL-2.0": TEMPLATES["GPL-3.0"].replace("version 3", "version 2"),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Unlicense-notice": "Released into the public domain under the Unlicense.",
}

PORTS = {"4.0": "International", "3.0": "Unported"}


def short_forms():
    """Short forms by name, found word for word."""
    out = {}
    parts = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(["Attribution", *(parts[x] for x in kind.split("-")[1:])])
        out[f"CC-{kind}-short"] = f"Licensed under CC {kind}"
        out[f"CC-{kind}-name"] = f"Creative Commons {long}"
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{kind}-{v}-id"] = f"CC {kind} {v}"
            out[f"CC-{kind}-{v}-short"] = f"Licensed under CC {kind} {v}"
            out[f"CC-{kind}-{v}-name"] = f"Creative Commons {long} {v}"
            out[f"CC-{kind}-{v}-short-notice"] = f"This work is licensed under a Creative Commons {long} {v} {PORTS.get(v, 'Generic')} License."
    out |= {"CC0-1.0-id": "CC0 1.0", "CC0-short": "Licensed under CC0", "CC0-1.0-name": "CC0 1.0 Universal"}
    for name, title, versions in (
        ("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
        ("AGPL", "GNU Affero General Public License", ("3",)), ("MPL", "Mozilla Public License", ("1.1", "2.0")),
        ("EPL", "Eclipse Public License", ("1.0", "2.0")),
    ):
        for v in versions:
            full = v if "." in v else f"{v}.0"
            out[f"{name}-{full}-short-notice"] = f"Licensed under the {title} version {v}"
            for form, version in {"short": f"version {v}", "full": f"version {full}", "v": f"v{v}", "v-full": f"v{full}", "v-point": f"v. {full}"}.items():
                out[f"{name}-{full}-{form}"] = f"under the {title} {version}"
            out[f"{name}-{full}-id"] = f"under {name} {full}"
            out[f"{name}-{full}-v-id"] = f"under {name}v{v}"
    out |= {"BSD-2-Clause-short": "under the BSD 2-Clause License", "BSD-3-Clause-short": "under the BSD 3-Clause License"}
    out |= {"MIT-short": "under the MIT License", "ISC-short": "under the ISC License", "Zlib-short": "under the zlib License"}
    out |= {"Apache-2.0-short": "under the Apache License 2.0", "Apache-2.0-id": "under Apache 2.0"}
    spdx = "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 ISC MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 PSF-2.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim WTFPL X11 Zlib".split()
    spdx += [f"CC-{k}-{v}" for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    spdx += [f"{g}{x}" for g in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for x in ("", "-only", "-or-later")]
    out |= {f"{x}-SPDX": f"SPDX-License-Identifier: {x}" for x in spdx}
    return out


SHORT_FORMS = short_forms()
COVERAGE, SPREAD, MAX_TEMPLATES = 0.8, 2.0, 5_000
WORD = r"[\p{L}\p{N}]+"


def words_of(text):
    import regex

    return regex.findall(WORD, text.lower())


def increasing(values):
    """Positions of a longest strictly increasing run of the values, by patience sorting."""
    from bisect import bisect_left

    tops, piles, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else None)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else None
    while i is not None:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a, b):
    """Aligned pairs (i, j) of equal words of the lists a and b, increasing in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, lo2, hi2 = todo.pop()
        while lo < hi and lo2 < hi2 and a[lo] == b[lo2]:
            found.append((lo, lo2))
            lo, lo2 = lo + 1, lo2 + 1
        while lo < hi and lo2 < hi2 and a[hi - 1] == b[hi2 - 1]:
            hi, hi2 = hi - 1, hi2 - 1
            found.append((hi, hi2))
        if lo >= hi or lo2 >= hi2:
            continue
        once = {}
        for side, words, x, y in ((0, a, lo, hi), (1, b, lo2, hi2)):
            for i in range(x, y):
                once.setdefault(words[i], ([], []))[side].append(i)
        anchors = sorted((p[0], q[0]) for p, q in once.values() if len(p) == 1 and len(q) == 1)
        anchors = [anchors[i] for i in increasing([j for _, j in anchors])]
        if not anchors:
            continue
        found += anchors
        for (i, j), (i2, j2) in zip([(lo - 1, lo2 - 1), *anchors], [*anchors, (hi, hi2)]):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(found)


class Templates:
    """Templates as word lists, with their words' owners and key words."""

    def __init__(self, texts, coverage, short=None):
        texts = texts | (short or {})
        if len(texts) > MAX_TEMPLATES:
            raise ValueError("too many templates to ship with the code")
        self.items = [(name, words_of(t)) for name, t in sorted(texts.items())]
        self.items = [(n, w) for n, w in self.items if w]
        self.whole = {k for k, (n, _) in enumerate(self.items) if n in (short or {})}
        owners = {}
        for k, (_, w) in enumerate(self.items):
            for x in set(w):
                owners.setdefault(x, set()).add(k)
        self.need = [-(-int(coverage * 1000) * len(w) // 1000) if k not in self.whole else len(w) for k, (_, w) in enumerate(self.items)]
        # a place that lacks all key words lacks too many words: the rarest words whose places exceed what may be missing
        self.keys = {}
        for k, (_, w) in enumerate(self.items):
            missing, order = 0, sorted(set(w), key=lambda x: (x.isdigit(), len(owners[x]), -len(x), x))
            for x in order:
                self.keys.setdefault(x, []).append(k)
                missing += w.count(x)
                if missing > len(w) - self.need[k]:
                    break


def find(words, templates, hits, coverage, spread):
    """(template, first word, last word, aligned, coverage) of one document, best of overlapping ones; hits: key word places."""
    from collections import Counter

    spans = {}
    for i in hits:
        for k in templates.keys[words[i]]:
            spans.setdefault(k, []).append(i)
    found = []
    for k, places in spans.items():
        name, w = templates.items[k]
        if k in templates.whole:  # word for word around the key word
            starts = {i - o for i in places for o, x in enumerate(w) if x == words[i] and i >= o}
            found += [(name, a, a + len(w) - 1, len(w), 1.0) for a in starts if words[a : a + len(w)] == w]
            continue
        reach = int(spread * len(w))
        want = Counter(w)
        done = -1
        for i in places:
            a, b = max(done + 1, i - reach), min(len(words), i + reach + 1)
            while b - a >= templates.need[k]:
                have = Counter(words[a:b])
                if sum(min(n, have[x]) for x, n in want.items()) < templates.need[k]:
                    break
                pairs = best_chain(patience(words[a:b], w), reach)
                if len(pairs) < templates.need[k]:
                    # the words are there, but repeated: look once from each side of the key word
                    tries = [(x, y) for x, y in ((max(a, i - len(w)), min(b, i + len(w))), (a, i + 1), (i, b)) if y - x >= templates.need[k]]
                    tried = [(best_chain(patience(words[x:y], w), reach), x) for x, y in tries]
                    pairs, x = max(tried, key=lambda t: len(t[0]), default=([], a))
                    if len(pairs) < templates.need[k]:
                        break
                    a = x
                first, last = a + pairs[0][0], a + pairs[-1][0]
                found.append((name, first, last, len(pairs), len(pairs) / len(w)))
                done = last
                a = last + 1
                if i <= last:
                    break
    found.sort(key=lambda f: (-f[3], -f[4], f[0], f[1]))
    out = []
    for f in found:
        if all(f[2] < g[1] or g[2] < f[1] for g in out):
            out.append(f)
    return sorted(out, key=lambda f: f[1])


def best_chain(pairs, reach):
    """The longest run of aligned pairs within ``reach`` words of the document."""
    best, lo = (0, 0), 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] >= reach:
            lo += 1
        if hi + 1 - lo > best[1] - best[0]:
            best = (lo, hi + 1)
    return pairs[best[0] : best[1]]


def scan(docs, texts=None, coverage=COVERAGE, spread=SPREAD):
    """Finds of docs(doc_id, text): doc_id, license, first_word, last_word, n_aligned, coverage; one row each."""
    templates = docs.sparkSession.sparkContext.broadcast(Templates(texts or TEMPLATES, coverage, None if texts else SHORT_FORMS))
    keys = templates.value.keys
    lower = F.lower(F.coalesce("text", F.lit("")))
    # most documents hold no key word at all, or too few; the rough test reads bytes only, the words are cut afterwards
    rows = docs.select("doc_id", lower.alias("text")).filter(F.col("text") != "")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import regex

        t = templates.value
        word = regex.compile(WORD)
        any_key = "(?:^|[^a-z0-9])(?:" + "|".join(sorted(map(regex.escape, keys), key=len, reverse=True)) + ")(?:[^a-z0-9]|$)"
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                hit = np.flatnonzero(np.asarray(pc.match_substring_regex(part.column("text"), any_key)))
                for r in hit:
                    words = word.findall(part.column("text")[int(r)].as_py())
                    places = [i for i, w in enumerate(words) if w in t.keys]
                    if places:
                        doc = part.column("doc_id")[int(r)].as_py()
                        out += [(doc, *f) for f in find(words, t, places, coverage, spread)]
                if out:
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), types)], names)

    names = ["doc_id", "license", "first_word", "last_word", "n_aligned", "coverage"]
    return rows.mapInArrow(run, "doc_id long, license string, first_word long, last_word long, n_aligned long, coverage double")


def op10_license_align(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_align": op10_license_align}
ORACLE_SQL = {}
