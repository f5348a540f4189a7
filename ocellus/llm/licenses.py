"""License scan with DataFrame functions alone: Dice coefficient of word bigrams against licence templates."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import public_id, slim

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
at https://www.eclipse.org/legal/epl-2.0/"""
_BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
_UNLICENSE = "This is free and unencumbered software released into the public domain."

#: Fixed values: (licence, template text). Short notices, the opening or naming passages of long texts, and the full texts of short licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_REST),
    ("MIT", f"{_MIT} {_MIT_REST}"),
    ("ISC", _ISC),
    ("BSD", _BSD),
    ("BSD", _BSD_REST),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_REST}"),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", f"{_BSD_2} 3. {_BSD_3} {_BSD_REST}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", _LGPL.format("2.1")),
    ("LGPL-3.0", _LGPL.format(3)),
    ("AGPL-3.0", _AGPL),
    ("EPL-2.0", _EPL),
    ("BSL-1.0", _BOOST),
    ("Zlib", _ZLIB),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
]


def template_bigrams(text: str) -> Counter:
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a text whose Dice coefficient with ``size`` bigrams can reach the threshold."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _ranges(templates, threshold: float) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(bounds(sum(template_bigrams(t).values()), threshold) for _, t in templates):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_WORD = r"[\p{L}\p{N}]++"
#: Lines without a word lie between paragraphs.
_BREAK = r"\n[^\p{L}\p{N}]*+\n"


def _unit(kind: str, number: Column, words: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"), words.alias("words"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def equals(k: str):
    return lambda x: x == k


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    r"""Licence notices and texts that a document holds as a line, a paragraph, or as a whole.

    A unit's words are its runs of letters and digits, lower-cased. Units are lines; paragraphs (between lines without a
    word) of texts with several lines; and the document, where it has several paragraphs. A unit whose number of bigrams is outside the bounds
    of every template is dropped; the others get 2 * shared / (both sizes), bigrams counted as often as they occur, with each
    template whose bounds they meet. Returns for each row doc_id, matches (unit kind, its number, licence, dice; the best template of
    a unit, ties to the later licence name), n_matches, license and dice of the best match (null without any; ties as before).
    Null and empty texts match nothing. A null doc_id comes back null; repeated rows are scanned alike; an empty table gives no rows. Very
    long texts are read whole, as one row's arrays; all other columns are left out, whatever their names.
    All of it is one projection: no shuffle, no Python, and nothing is gathered over rows.
    """
    grams = sorted({g for _, text in templates for g in template_bigrams(text)})
    vocabulary = sorted({w for g in grams for w in g.split()})
    ranges = _ranges(templates, threshold)

    def fits(words: Column) -> Column:
        """The size bounds; then enough words of the templates, as each shared bigram has two."""
        n = F.size(words)
        ok = F.lit(False)
        for lo, hi in ranges:
            ok = ok | n.between(lo + 1, hi + 1)
        return ok & (2 * F.size(F.filter(words, lambda w: w.isin(*vocabulary))) >= threshold * (n - 1))

    def dice(u: Column) -> Column:
        scores = []
        for name, text in templates:
            want = template_bigrams(text)
            size = sum(want.values())
            lo, hi = bounds(size, threshold)
            keys = F.array(*[F.lit(k) for k in want])
            shared = F.size(F.array_intersect(u["known"], keys))
            for k, times in want.items():
                if times > 1:  # array_intersect counts each once
                    shared = shared + F.greatest(F.least(F.size(F.filter(u["known"], equals(k))), F.lit(times)) - 1, F.lit(0))
            n = u["n"]
            scores.append(F.when(n.between(lo, hi), F.struct((2 * shared / (n + size)).alias("dice"), F.lit(name).alias("license"))))
        return F.array_max(F.array(*scores))

    def paired(u: Column) -> Column:
        pairs = F.transform(F.slice(u["words"], 1, F.size(u["words"]) - 1), lambda w, i: F.concat_ws(" ", w, F.get(u["words"], i + 1)))
        known = F.filter(pairs, lambda g: g.isin(*grams))  # no other can be shared
        return F.struct(u["kind"].alias("kind"), u["number"].alias("number"), (F.size(u["words"]) - 1).alias("n"), known.alias("known"))

    def judged(u: Column) -> Column:
        return F.struct(u["kind"].alias("kind"), u["number"].alias("number"), dice(u).alias("best"))

    def named(u: Column) -> Column:
        return F.struct(u["kind"].alias("kind"), u["number"].alias("number"), u["best"]["license"].alias("license"), u["best"]["dice"].alias("dice"))

    lines = F.transform(F.split("low", "\n"), lambda x, i: _unit("line", i, _words(x)))
    total = F.aggregate("lines", F.lit(0), lambda a, u: a + F.size(u["words"]))
    all_words = F.flatten(F.transform("lines", lambda u: u["words"]))
    whole = F.when(total <= ranges[-1][1] + 1, all_words)  # no larger unit can meet the bounds
    cut = F.filter(F.transform(F.split("low", _BREAK), lambda x, i: _unit("paragraph", i, _words(x))), lambda u: F.size(u["words"]) > 0)
    several = F.when(F.col("low").rlike(_BREAK), cut)
    larger = F.when(F.size(F.col("several")) > 1, F.concat("several", F.array(_unit("document", F.lit(0), F.col("whole"))))).otherwise(F.array(_unit("paragraph", F.lit(0), F.col("whole"))))
    candidates = F.filter(F.concat("lines", F.when(F.size("lines") > 1, larger).otherwise(F.slice("lines", 1, 0))), lambda u: fits(u["words"]))
    # one projection for each, as each is used several times by the next
    out = slim(docs).select("doc_id", F.lower("text").alias("low")).withColumn("lines", lines).select("doc_id", "lines", several.alias("several"), whole.alias("whole")).select("doc_id", candidates.alias("candidates"))
    # each transform gives the next one fields to refer to, so nothing is computed twice
    scored = F.transform(F.transform("candidates", paired), judged)
    matches = F.transform(F.filter(scored, lambda m: m["best"]["dice"] >= threshold), named)
    out = out.select("doc_id", matches.alias("matches"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))))
    return out.select(public_id(), "matches", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), best["dice"].alias("dice"))


def _oracle() -> str:
    values = ", ".join(f"({k}, '{name}', '{g}', {n})" for k, (name, text) in enumerate(TEMPLATES) for g, n in template_bigrams(text).items())
    return rf"""
WITH t(tid, license, gram, times) AS (VALUES {values}),
size AS (SELECT tid, license, sum(times) AS size FROM t GROUP BY ALL),
norm AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\n[^\p{{L}}\p{{N}}]*\n'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS ps FROM norm),
u0 AS (
  SELECT doc_id, 'line' AS kind, generate_subscripts(string_split(text, chr(10)), 1) AS number, unnest(string_split(text, chr(10))) AS unit FROM norm
  UNION ALL SELECT doc_id, 'paragraph', generate_subscripts(ps, 1), unnest(ps) AS unit FROM p WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, 'document', 1, text FROM p WHERE len(ps) > 1
), u AS (SELECT doc_id, kind, number, trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS unit FROM u0
), s AS (SELECT *, len(string_split(unit, ' ')) - 1 AS n FROM u WHERE unit <> ''),
c AS (SELECT * FROM s WHERE EXISTS (SELECT 1 FROM size WHERE n >= ceil(size * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9) AND n <= floor(size * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9))),
g AS (SELECT doc_id, kind, number, n, gram, count(*) AS times FROM (
  SELECT doc_id, kind, number, n, ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT *, string_split(unit, ' ') AS ws FROM c))) GROUP BY ALL),
d AS (
  SELECT doc_id, kind, number, size.license, cast(2 * sum(least(g.times, t.times)) AS DOUBLE) / (n + size) AS dice
  FROM g JOIN t ON t.gram = g.gram JOIN size ON size.tid = t.tid
  WHERE n >= ceil(size * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9) AND n <= floor(size * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)
  GROUP BY doc_id, kind, number, t.tid, size.license, n, size
), best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY dice DESC, license DESC) = 1),
m AS (SELECT doc_id, count(*) AS n_matches, first(license ORDER BY dice DESC, license DESC) AS license, max(dice) AS dice FROM best WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_matches, 0) AS n_matches, license, round(dice, 6) AS dice FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id
"""


ORACLE = _oracle()
