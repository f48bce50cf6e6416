"""License scans by patience alignment.

A notice is found by aligning its template with a window of the text: words that occur once in both are
anchors, the longest increasing run of anchors stays, and the gaps between them are aligned the same
way. Coverage is the share of template words matched within a stretch not much longer than the template.

Where to look is decided without loss: a match of the least coverage can miss only so many template words,
so one word more of the corpus-wide rarest ones (counted over all texts) must occur in it, and each
occurrence of such a word is looked at, in windows around the places the template would then take. Words that
were reported are not looked at again; those before and after them are.

Coverage alone cannot tell licences apart whose notices differ in a name or a number. A template may have
telling phrases: their words must all be matched, side by side in the text, whatever the coverage. The
registered query searches for :func:`catalogue`, where every template has them.

Defined cases: a null or empty text has no notice; repeated rows and null ids are documents of their own;
a notice that stands several times is reported each time; of templates that match at the same words the one
with most matched words is kept, then the one with most coverage, then the first by name. A licence outside
the catalogue has no name. Extra columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.llm.decontaminate import words_of

#: Texts of common notices; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
}
#: Licences as one-line notices name them, and the words of the name that no other licence may have there.
NAMES = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3|gnu affero general public license|version 3", "the AGPL-3.0|agpl 3 0", "the AGPLv3|agplv3"),
    "Apache-1.1": ("the Apache License, Version 1.1|apache|version 1 1", "Apache-1.1|apache 1 1"),
    "Apache-2.0": ("the Apache License, Version 2.0|apache|version 2 0", "the Apache License 2.0|apache license 2 0", "the Apache License v2.0|apache license v2 0", "Apache-2.0|apache 2 0"),
    "Artistic-2.0": ("the Artistic License 2.0|artistic license 2 0", "Artistic-2.0|artistic 2 0"),
    "BSD": ("the BSD License|bsd license", "a BSD style license|bsd style"),
    "BSD-2-Clause": ("the BSD 2-Clause License|bsd 2 clause", "the 2-Clause BSD License|2 clause bsd", "the Simplified BSD License|simplified bsd", "BSD-2-Clause|bsd 2 clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License|bsd 3 clause", "the 3-Clause BSD License|3 clause bsd", "the New BSD License|new bsd", "BSD-3-Clause|bsd 3 clause"),
    "BSD-4-Clause": ("the BSD 4-Clause License|bsd 4 clause", "the 4-Clause BSD License|4 clause bsd", "BSD-4-Clause|bsd 4 clause"),
    "BSL-1.0": ("the Boost Software License, Version 1.0|boost software license|version 1 0", "BSL-1.0|bsl 1 0"),
    "CC0-1.0": ("CC0 1.0|cc0 1 0", "CC0|cc0"),
    "CDDL-1.0": ("the Common Development and Distribution License, version 1.0|common development and distribution|version 1 0", "CDDL-1.0|cddl 1 0"),
    "EPL-1.0": ("the Eclipse Public License, version 1.0|eclipse public license|version 1 0", "EPL-1.0|epl 1 0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0|eclipse public license|version 2 0", "EPL-2.0|epl 2 0"),
    "EUPL-1.2": ("the European Union Public Licence, version 1.2|european union public|version 1 2", "the EUPL, version 1.2|eupl|version 1 2", "EUPL-1.2|eupl 1 2"),
    "GPL": ("the GNU General Public License|gnu general public license", "the GNU GPL|gnu gpl", "the GPL|gpl"),
    "GPL-2.0": ("the GNU General Public License, version 2|gnu general public license|version 2", "the GNU General Public License v2|gnu general public license|v2", "the GNU GPL, version 2|gnu gpl|version 2", "the GPL, version 2|gpl|version 2", "GPL-2.0|gpl 2 0", "the GPLv2|gplv2"),
    "GPL-3.0": ("the GNU General Public License, version 3|gnu general public license|version 3", "the GNU General Public License v3|gnu general public license|v3", "the GNU GPL, version 3|gnu gpl|version 3", "the GPL, version 3|gpl|version 3", "GPL-3.0|gpl 3 0", "the GPLv3|gplv3"),
    "ISC": ("the ISC License|isc", "ISC|isc"),
    "LGPL": ("the GNU Lesser General Public License|gnu lesser general public license", "the GNU LGPL|gnu lgpl", "the LGPL|lgpl"),
    "LGPL-2.0": ("the GNU Library General Public License, version 2|gnu library general public license|version 2",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1|gnu lesser general public license|version 2 1", "the LGPL, version 2.1|lgpl|version 2 1", "LGPL-2.1|lgpl 2 1", "the LGPLv2.1|lgplv2 1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3|gnu lesser general public license|version 3", "the LGPL, version 3|lgpl|version 3", "LGPL-3.0|lgpl 3 0", "the LGPLv3|lgplv3"),
    "MIT": ("the MIT License|mit", "MIT|mit"),
    "MIT-0": ("the MIT-0 License|mit 0", "the MIT No Attribution License|mit no attribution"),
    "MPL-1.1": ("the Mozilla Public License, version 1.1|mozilla public license|version 1 1", "MPL-1.1|mpl 1 1"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0|mozilla public license|version 2 0", "MPL-2.0|mpl 2 0"),
    "Unlicense": ("the Unlicense|the unlicense", "Unlicense|unlicense"),
    "WTFPL": ("the WTFPL|wtfpl", "WTFPL|wtfpl"),
    "Zlib": ("the zlib License|zlib", "zlib|zlib"),
}
_CC = {"": "Attribution", "-NC": "Attribution-NonCommercial", "-SA": "Attribution-ShareAlike", "-ND": "Attribution-NoDerivatives", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _long in _CC.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _tail = " ".join(f"{_kind} {_v}".replace("-", " ").replace(".", " ").split())
        NAMES[f"CC-BY{_kind}-{_v}"] = (f"CC BY{_kind} {_v}|cc by {_tail.lower()}", f"a Creative Commons {_long} {_v} License|{_long.replace('-', ' ').lower()} {_v.replace('.', ' ')}", f"a Creative Commons {_long} {_v} International License|{_long.replace('-', ' ').lower()} {_v.replace('.', ' ')}")
#: How a one-line notice begins.
LEADS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "SPDX-License-Identifier:")
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
#: Longer notices: licence, text, telling phrases.
BODIES = [
    ("Apache-2.0-header", TEMPLATES["Apache-2.0-header"], "apache|version 2 0"),
    ("MIT-permission", TEMPLATES["MIT-permission"], "permission is hereby granted|deal in the software without restriction"),
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "permission is hereby granted|to deal in the software|subject to the following conditions"),
    ("MIT-0", f"{_MIT}. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND", "permission is hereby granted|to deal in the software|to do so the software is provided"),
    ("BSD-2-Clause", _BSD, "redistribution and use in source and binary forms|with the distribution"),
    ("BSD-3-Clause", f"{_BSD} 3. {_NEITHER}", "redistribution and use in source and binary forms|to endorse or promote products derived"),
    ("BSD-4-Clause", f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder. 4. {_NEITHER}", "redistribution and use in source and binary forms|advertising materials mentioning|to endorse or promote products derived"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission to use copy modify|with or without fee|appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "permission to use copy modify|is hereby granted the software is provided"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.", "mozilla public license v 2 0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at www.boost.org/LICENSE_1_0.txt)", "boost software license version 1 0"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "alter it and redistribute it freely|must not be misrepresented"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived all copyright and related or neighboring rights"),
    *(
        (f"{short}-{v if '.' in v else v + '.0'}", _GNU.format(what=what, name=name, v=v), f"gnu {name.lower()}|either version {v.replace('.', ' ')} of the license")
        for short, name, versions in (("GPL", "General Public License", "123"), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("LGPL", "Library General Public License", "2"), ("AGPL", "Affero General Public License", "3"))
        for v in versions
        for what in ("program", "library")
    ),
]
LEAST_COVERAGE = 0.8
#: How many times longer than its template a notice may be in the text.
STRETCH = 1.5


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both, by patience alignment."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        once = [(k, place[w]) for k, w in enumerate(a[i:m], i) if in_a[w] == 1 and w in place]
        anchors = [once[k] for k in increasing([y for _, y in once])]
        if not anchors:
            continue
        pairs.extend(anchors)
        edges = [(i - 1, j - 1), *anchors, (m, n)]
        todo.extend((x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:]))
    return sorted(pairs)


def best_stretch(pairs: list[tuple[int, int]], longest: int) -> tuple[int, int, int]:
    """(matches, first, last) of the stretch of at most ``longest`` words of the text with most matches."""
    best, i = (0, 0, 0), 0
    for j in range(len(pairs)):
        while pairs[j][0] - pairs[i][0] >= longest:
            i += 1
        if j - i + 1 > best[0]:
            best = (j - i + 1, pairs[i][0], pairs[j][0])
    return best


def template_words(templates: dict[str, str]) -> dict[str, list[bytes]]:
    return {name: words_of(text) for name, text in templates.items()}


def catalogue() -> tuple[dict[str, str], dict[str, list[list[bytes]]], dict[str, str]]:
    """The templates of the registered query, their telling phrases, and the licence each stands for."""
    listed = [(licence, f"{lead} {name}", lead, telling) for licence, names in NAMES.items() for name, *telling in (x.split("|") for x in names) for lead in LEADS]
    out = [(licence, text, telling if lead in LEADS[:-1] else [*telling, "spdx license identifier"]) for licence, text, lead, telling in listed]
    out += [(licence, text, telling.split("|")) for licence, text, telling in BODIES]
    keys = [f"{licence}#{k}" for k, (licence, _, _) in enumerate(out)]
    return {k: t for k, (_, t, _) in zip(keys, out)}, {k: [words_of(p) for p in ps] for k, (_, _, ps) in zip(keys, out)}, {k: n for k, (n, _, _) in zip(keys, out)}


def tells(pairs: list[tuple[int, int]], own: list[bytes], phrases: list[list[bytes]]) -> bool:
    """Whether every phrase is matched whole, its words side by side in the text."""
    there = {b: a for a, b in pairs}

    def whole(phrase: list[bytes]) -> bool:
        n = len(phrase)
        starts = [k for k in range(len(own) - n + 1) if own[k : k + n] == phrase]
        return any(k in there and all(there.get(k + d) == there[k] + d for d in range(n)) for k in starts)

    return all(map(whole, phrases))


def word_documents(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the templates occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(words.intersection(words_of(text)))
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}  # a row per template word


def cues(words: dict[str, list[bytes]], counts: dict[bytes, int], least: float = LEAST_COVERAGE, telling: dict[str, list[list[bytes]]] | None = None) -> dict[str, set[bytes]]:
    """Per template the rarest words of which every match has one: a match lacks at most the share
    1 - ``least`` of the places, so the words chosen must fill more places than that. A telling word is in every match, so the
    rarest of them will do where it is the rarer choice."""
    out = {}
    for name, own in words.items():
        many, places, chosen = Counter(own), 0, set()
        for w in sorted(many, key=lambda w: (counts.get(w, 0), w)):
            chosen.add(w)
            places += many[w]
            if places > len(own) - np.ceil(least * len(own) - 1e-9):
                break
        rarest = min((w for p in (telling or {}).get(name, []) for w in p), key=lambda w: (counts.get(w, 0), w), default=None)
        if rarest is not None and counts.get(rarest, 0) <= sum(counts.get(w, 0) for w in chosen):
            chosen = {rarest}
        out[name] = chosen
    return out


def notice_at(words: list[bytes], own: list[bytes], i: int, low: int, least: float, phrases: list[list[bytes]]) -> tuple[int, int, int] | None:
    """(matches, first, last) of the best match that holds word ``i`` and begins at ``low`` or later.

    The windows are those in which the template would stand if ``i`` were each of its places, then these
    with the stretch on either side, then all that a stretch may reach, cut where another match begins.
    """
    longest = int(STRETCH * len(own))
    over, starts = longest - len(own), [i - j for j, w in enumerate(own) if w == words[i]]
    windows = [(at, at + len(own)) for at in starts] + [(at - over, at + len(own) + over) for at in starts] + [(i - longest + 1, i + longest)]
    best, tried = None, set()
    for lo, hi in windows:
        lo, hi = max(lo, low), min(hi, len(words))
        while lo <= i < hi and (lo, hi) not in tried:
            tried.add((lo, hi))
            pairs = patience(words[lo:hi], own)
            n, first, last = best_stretch(pairs, longest)
            if lo + first > i:
                hi = lo + first
                continue
            if n and lo + last < i:
                lo = lo + last + 1
                continue
            if n >= least * len(own) - 1e-9 and (best is None or n > best[0]) and tells([p for p in pairs if first <= p[0] <= last], own, phrases):
                best = (n, lo + first, lo + last)
        if best is not None and best[0] == len(own):
            break
    return best


def scan(
    words: list[bytes], templates: dict[str, list[bytes]], cue: dict[str, set[bytes]], least: float = LEAST_COVERAGE, telling: dict[str, list[list[bytes]]] | None = None
) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, last word) of every notice in a text."""
    found: list[tuple[int, str, float, int, int]] = []
    there = set(words)
    for name, own in templates.items():
        if there.isdisjoint(cue[name]):
            continue
        past = -1
        for i in [k for k, w in enumerate(words) if w in cue[name]]:
            if i <= past:
                continue
            match = notice_at(words, own, i, past + 1, least, (telling or {}).get(name, []))
            if match is not None:
                n, first, past = match
                found.append((n, name, n / len(own), first, past))
    kept: list[tuple[str, float, int, int]] = []
    for _, name, coverage, first, last in sorted(found, key=lambda x: (-x[0], -x[2], x[1], x[3])):
        if all(last < f or first > t for _, _, f, t in kept):
            kept.append((name, coverage, first, last))
    return sorted(kept, key=lambda x: x[2])


def license_notices(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, telling: dict[str, list[list[bytes]]] | None = None, names: dict[str, str] | None = None
) -> DataFrame:
    """(doc_id, n_words, notices) of every document; a notice has name, coverage, first and last word.
    Without ``telling`` phrases the coverage alone decides; ``names`` gives templates the name to report."""
    own = template_words(templates or TEMPLATES)
    own = {name: w for name, w in own.items() if w}
    cue = cues(own, word_documents(docs, {w for ws in own.values() for w in ws}), least, telling)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                notices = [((names or {}).get(name, name), *rest) for name, *rest in scan(words, own, cue, least, telling)]
                rows.append((len(words), [dict(zip(("name", "coverage", "first", "last"), x)) for x in notices]))
            yield pd.DataFrame(rows, columns=["n_words", "notices"])

    found = F.pandas_udf(run, "n_words long, notices array<struct<name string, coverage double, first long, last long>>")
    return docs.select("doc_id", found(F.col("text")).alias("f")).select("doc_id", "f.n_words", "f.notices")


def catalogue_notices(docs: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """The notices of :func:`license_notices` for the licences of the catalogue."""
    templates, telling, names = catalogue()
    return license_notices(docs, templates, least, telling, names)


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = catalogue_notices(table(spark, folder, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("notices.name"))), ",")
    return found.select("doc_id", "n_words", F.size("notices").alias("n_notices"), names.alias("licenses"), F.coalesce(F.array_max("notices.coverage"), F.lit(0.0)).alias("coverage"))
