import pytest

from strideforge.llm import license_align

LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "licensed under cc by-sa 3.0": "CC-BY-SA-3.0",
    "Photo: CC BY-NC-ND 2.0": "CC-BY-NC-ND-2.0", "Licensed under CC BY-NC.": "CC-BY-NC",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.": "CC-BY-NC-3.0",
    "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: Artistic-2.0": "Artistic-2.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later", "SPDX-License-Identifier: Foo-2.0": None,
    "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Released into the public domain under the Unlicense.": "Unlicense", "please cc by friday 4 of 0": None,
}


def names(spark, values):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    out = {}
    for r in license_align.scan(docs).collect():
        out.setdefault(r.doc_id, []).append(r.license)
    return out


def test_every_form_is_found_as_itself(spark):
    got = names(spark, [f"Some words before it.\n{x}\nAnd after it." for x in LINES])
    for i, (line, want) in enumerate(LINES.items()):
        ends = ("", "-short", "-short-notice", "-id", "-name", "-notice", "-SPDX", "-full")
        assert got.get(i) is None if want is None else len(got[i]) == 1 and got[i][0] in [want + e for e in ends], (line, got.get(i))


def test_long_headers(spark):
    full = [k for k in license_align.TEMPLATES if not k.endswith("-notice")]
    assert names(spark, [license_align.TEMPLATES[k] for k in full]) == {i: [k] for i, k in enumerate(full)}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_license_lines_of_the_given_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lines = docs.filter("text rlike '(?mi)^(This work is licensed|licensed|released) under .*$'").select("doc_id").distinct()
    assert lines.count() > 30
    assert lines.join(license_align.scan(docs), "doc_id", "left_anti").count() == 0
