"""Patience alignment and the notices it finds."""

from __future__ import annotations

import random

from touchline.llm import licenses
from touchline.llm.decontaminate import words_of


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.patience(list("abcxde"), list("abcde")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4)]
    assert licenses.patience(list("zzabzz"), list("ab")) == [(2, 0), (3, 1)]
    assert [licenses.increasing(v) for v in ([], [3], [2, 5, 3, 4, 1])] == [[], [0], [0, 2, 3]]


def test_cues_lose_nothing():
    own = licenses.template_words(licenses.TEMPLATES)
    rng = random.Random(5)
    counts = {w: rng.randint(1, 99) for ws in own.values() for w in ws}
    for name, cue in licenses.cues(own, counts).items():
        n = len(own[name])
        rest = [w for w in own[name] if w not in cue]
        assert len(rest) < licenses.LEAST_COVERAGE * n


def test_notices(spark):
    filler = " ".join(f"the x{i} of this license-free work is" for i in range(80))
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    texts = {
        1: f"{filler}\n{mit}\n{filler}", 2: f"{mit} {mit} {filler} {apache.upper()}", 3: filler, 4: None, 5: "", 6: "Released under the BSD License.",
        7: apache.replace("License,", "Licence,") + filler, 8: "licensed " * 500, 9: licenses.TEMPLATES["Apache-2.0-header"], 10: f"{filler} licensed under the GNU General Public License version 3",
    }
    df = spark.createDataFrame([*((i, t, 1) for i, t in texts.items()), (1, texts[1], 2), (None, mit, 3)], "doc_id long, text string, notices int")
    rows = licenses.license_notices(df).collect()
    got = {r.doc_id: [n.name for n in r.notices] for r in rows}
    assert got == {1: ["MIT"], 2: ["MIT", "MIT", "Apache-2.0"], 3: [], 4: [], 5: [], 6: ["MIT"], 7: ["Apache-2.0"], 8: [], 9: ["Apache-2.0-header"], 10: ["GPL-3.0"], None: ["MIT"]}
    first = next(r for r in rows if r.doc_id == 1).notices[0]
    at = len(words_of(filler))
    assert (first.coverage, first.first, first.last) == (1.0, at, at + 4)
    assert len(rows) == len(texts) + 2 and licenses.license_notices(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    lines = {n: licenses.TEMPLATES[n] for n in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT")}
    for r in licenses.op2_licenses(spark, folder).collect():
        assert set(filter(None, r.licenses.split(","))) == {n for n, line in lines.items() if line in texts[r.doc_id]}


def test_neighbours_are_told_apart(spark):
    """Licences whose notices differ in a name or a number; None: not in the catalogue."""
    filler = " ".join(f"some other x{i} words" for i in range(40))
    bodies = {name: text for name, text, _ in licenses.BODIES}
    lines = {
        "Released under the BSD License.": "BSD", "Released under the MIT License.": "MIT", "Released under the Foo License.": None, "Released under the MIT-0 License.": "MIT-0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-SA 3.0": "CC-BY-SA-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the Mozilla Public License, version 2.0": "MPL-2.0", "Released under the ISC License": "ISC", "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
        "Licensed under the BSD 2-Clause License": "BSD-2-Clause", "SPDX-License-Identifier: MIT": "MIT", "Licensed under the GNU General Public License, version 3. 2 more": "GPL-3.0", "Licensed under the GNU General Public License, version 2. 3 more": "GPL-2.0", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "Licensed under the GPLv3": "GPL-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", bodies["BSD-2-Clause"]: "BSD-2-Clause", bodies["BSD-3-Clause"]: "BSD-3-Clause", bodies["ISC"]: "ISC", bodies["MPL-2.0"]: "MPL-2.0",
        bodies["MIT"]: "MIT", bodies["MIT-0"]: "MIT-0", bodies["GPL-2.0"]: "GPL-2.0", bodies["GPL-3.0"]: "GPL-3.0", bodies["LGPL-2.1"]: "LGPL-2.1", bodies["LGPL-3.0"]: "LGPL-3.0", bodies["AGPL-3.0"]: "AGPL-3.0", bodies["0BSD"]: "0BSD",
    }
    df = spark.createDataFrame([(i, f"{filler}\n{text}\n{filler}") for i, text in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: [n.name for n in r.notices] for r in licenses.catalogue_notices(df).collect()}
    assert {text: got[i] for i, text in enumerate(lines)} == {text: [name] if name else [] for text, name in lines.items()}


def test_catalogue_is_sound():
    templates, telling, names = licenses.catalogue()
    own = licenses.template_words(templates)
    assert all(licenses.tells([(i, i) for i in range(len(own[k]))], own[k], telling[k]) and telling[k] for k in own)
    assert all(own[k] for k in own) and set(names) == set(own)


def test_runs_of_copies():
    """Copies back to back after other text are found one by one, whichever words are the cues."""
    other = words_of("some other text of twelve words that has nothing to do here")
    for name, text in [*licenses.TEMPLATES.items(), ("line", "Licensed under the Boost Software License, Version 1.0")]:
        own = words_of(text)
        for rare in [set(own[:1]), set(own[-1:]), *({w} for w in own), set(own)]:
            for copies in (1, 2, 3, 7):
                got = licenses.scan(other + own * copies + other, {name: own}, {name: rare})
                assert [x[2:] for x in got] == [(len(other) + k * len(own), len(other) + (k + 1) * len(own) - 1) for k in range(copies)], (name, rare, copies)
    gpl = words_of(licenses.TEMPLATES["GPL-3.0"])
    cut = [w for w in gpl if w != b"work"]
    assert len(licenses.scan(other + cut + gpl + cut + other, {"GPL-3.0": gpl}, {"GPL-3.0": {b"gnu", b"general", b"public"}})) == 3
