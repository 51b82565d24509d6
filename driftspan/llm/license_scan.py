"""Licence scans by Dice coefficient over word bigrams, in DataFrame operations only.

A text is normalised (ASCII letters and digits, lower case, single spaces) and cut into blocks:
its lines, its paragraphs and itself. A block is compared with a licence template only if the
number of its distinct bigrams lies within the bounds that the threshold sets: for Dice >= t,
between t/(2-t) and (2-t)/t times the template's. The score is 2 * common / (sum of both).

A licence that no block shows (one of several paragraphs, a wrapped one with lines around it, or
one in mid-line) is sought in the word windows of the whole text. A best window begins and ends
with a bigram of the template, so from each such bigram on, the best end is taken, up to the
most bigrams that can match. A window inside a better one of another template is that one's part.

Before that, texts and blocks that cannot match are dropped without loss: a text without any cue
word (below) is not cut into words at all; one is cut into blocks only if it holds as many of
some template's bigrams as a match shares with it at least; and a block that reaches the
threshold must hold one of any set of (bigrams - least common + 1) of them, so it must hold one of
that template's cue words, which are chosen to cover such a set. No text crosses a shuffle and
nothing is grouped.

The templates are the one-line and file notices of the licences and the whole texts of MIT, ISC,
BSD-2-Clause, BSD-3-Clause and Zlib; the bodies of the longer licences are left out.

Defined cases: null or empty text has no licence; equal blocks of a text count once; of
several templates over the threshold the best is reported, ties by name; all names found
are listed; a licence found in windows only counts as one match, however often it occurs; a very
long text is scanned whole; repeated rows get the same result; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import lower_ascii, read_table

THRESHOLD = 0.8

# Notices and short texts of common public licences. The bodies of Apache, CC, GPL, LGPL, AGPL and MPL are not among them.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
}

_BSD_TERMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
_BSD_NAMES = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. '
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Whole licences that the SQL's templates lack.
TEXTS = {
    "BSD-2-Clause-text": _BSD_TERMS + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER,
    "Zlib-text": TEMPLATES["Zlib"] + " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a block that can reach the threshold with a template of n."""
    ratio = threshold / (2 - threshold)
    return math.ceil(n * ratio - 1e-9), math.floor(n / ratio + 1e-9)


def cue_words(templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every block that matches any template holds one.

    A match shares at least ceil(t/(2-t) * n) of a template's n bigrams, so it holds one of any
    n - that + 1 of them. Words that cover so many bigrams are taken, those that few other
    templates' words resemble (long ones) first.
    """
    cues: set[str] = set()
    for text in templates.values():
        own = bigrams(text)
        need = len(own) - math.ceil(len(own) * threshold / (2 - threshold) - 1e-9) + 1
        left = [b.split() for b in own]
        covered = sum(any(w in cues for w in b) for b in left)
        left = [b for b in left if not any(w in cues for w in b)]
        while covered < need:
            counts = Counter(w for b in left for w in set(b))
            word = max(counts, key=lambda w: (len(w) >= 5, counts[w], w))
            cues.add(word)
            covered += counts[word]
            left = [b for b in left if word not in b]
    return sorted(cues)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _holds_cue(t: Column, cues: list[str]) -> Column:
    """Whether a lower-cased text can hold a cue word; the short ones, which longer words often contain, are sought as words."""
    short = [c for c in cues if len(c) <= 3]
    found = [F.contains(t, F.lit(c)) for c in cues if len(c) > 3]
    return _any([*found, t.rlike(f"(?<![a-z0-9])({'|'.join(short)})(?![a-z0-9])")] if short else found)


def _matches(sets: Column, name: str, own: list[str], threshold: float) -> Column:
    """(dice, name) of the blocks' bigram sets that reach the threshold with one template; only sets within its size bounds are compared."""
    lo, hi = size_bounds(len(own), threshold)
    literal = F.array(*[F.lit(b) for b in own])
    fitting = F.filter(sets, lambda s: F.size(s).between(lo, hi))
    scored = F.transform(fitting, lambda s: F.struct((F.lit(2.0) * F.size(F.array_intersect(s, literal)) / (F.size(s) + F.lit(len(own)))).alias("dice"), F.lit(name).alias("name")))
    return F.filter(scored, lambda x: x["dice"] >= F.lit(threshold))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _best_end(tagged: Column, start: Column, template: Column) -> Column:
    """(dice, name, lo, hi) of the best window that begins at start; bigrams of the template are tagged '+'."""
    part = F.slice(tagged, start, template["longest"])

    def grown(s: Column, g: Column) -> Column:
        seen, common = s["seen"] + 1, s["common"] + F.when(g.startswith("+"), 1).otherwise(0)
        dice = F.lit(2.0) * common / (seen + template["n"])
        better = dice > s["dice"]
        return F.struct(seen.alias("seen"), common.alias("common"), F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, g).otherwise(s["last"]).alias("last"))

    none = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("common"), F.lit(0.0).alias("dice"), F.lit("").alias("last"))
    best = F.aggregate(F.array_distinct(part), none, grown)
    return _let(best, lambda b: F.struct(b["dice"].alias("dice"), template["name"].alias("name"), start.alias("lo"), (start + F.array_position(part, b["last"]) - 1).alias("hi")))


def _covers(y: Column, x: Column) -> Column:
    """Whether window x is a part of y, a better one of another template, or an equally good but longer one."""
    longer = y["hi"] - y["lo"] > x["hi"] - x["lo"]
    return (y["name"] != x["name"]) & (y["lo"] <= x["lo"]) & (y["hi"] >= x["hi"]) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & longer))


def _windows(text_grams: Column, templates: Column, threshold: float) -> Column:
    """(dice, name, lo, hi) of the windows of a text's consecutive bigrams that reach the threshold with one of templates."""

    def of(template: Column) -> Column:
        tagged = F.transform(text_grams, lambda g: F.concat(F.when(F.array_contains(template["own"], g), "+").otherwise("-"), g))

        def within(t: Column) -> Column:
            hits = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.element_at(t, i).startswith("+"))
            starts = _let(hits, lambda h: F.filter(h, lambda p, k: F.get(h, k + template["need"] - 1) - p < template["longest"]))
            return F.filter(F.transform(starts, lambda p: _best_end(t, p, template)), lambda x: x["dice"] >= F.lit(threshold))

        return _let(tagged, within)

    whole = lambda found: F.filter(found, lambda x: ~F.exists(found, lambda y: _covers(y, x)))
    return _let(F.flatten(F.transform(templates, of)), whole)


def _template_rows(templates: dict[str, str], threshold: float) -> Column:
    """Of each template its name, bigrams, fewest common ones of a match, and most consecutive ones of a window."""
    rows = []
    for name, text in sorted(templates.items()):
        own, words = bigrams(text), len(re.findall("[a-z0-9]+", text.lower()))
        need, longest = size_bounds(len(own), threshold)[0], size_bounds(words - 1, threshold)[1]
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(len(own)).alias("n"), F.lit(need).alias("need"), F.lit(longest).alias("longest"), F.array(*[F.lit(b) for b in own]).alias("own")))
    return F.array(*rows)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, dice, licenses, n_blocks) of every row: the best template and its score, all names, matching blocks."""
    templates = templates or TEMPLATES | TEXTS
    cues = cue_words(templates, threshold)
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select("id", F.when(_holds_cue(F.col("t"), cues), F.col("t")).otherwise("").alias("t"))

    def normal(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))

    lines = F.split(F.col("t"), "\n")
    paragraphs = F.split(F.col("t"), "\n[ \t\r]*\n")
    blocks = F.concat(lines, paragraphs, F.array(F.col("t")))
    blocks = F.filter(blocks, lambda b: _any([F.contains(b, F.lit(c)) for c in cues]))
    blocks = F.array_distinct(F.transform(blocks, normal))

    def pairs(words: Column) -> Column:
        return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda x, y: F.concat(x, F.lit(" "), y))

    def grams(b: Column) -> Column:
        words = F.split(b, " ")
        return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs(words)))

    known = sorted({b for text in templates.values() for b in bigrams(text)})
    rows = rows.select("id", "t", F.split(normal(F.col("t")), " ").alias("words"))
    rows = rows.select("id", "t", pairs(F.col("words")).alias("g"))
    rows = rows.select("id", "t", "g", F.array_distinct(F.filter("g", lambda g: g.isin(known))).alias("common"))
    possible = F.filter(_template_rows(templates, threshold), lambda x: (F.size("common") >= x["need"]) & (F.size(F.array_intersect(F.col("common"), x["own"])) >= x["need"]))
    rows = rows.select("id", "t", "g", possible.alias("possible"))
    some = F.size("possible") > 0
    rows = rows.select("id", "g", "possible", F.when(some, F.transform(blocks, grams)).alias("sets"))
    found = F.concat(*[_matches(F.col("sets"), name, bigrams(template), threshold) for name, template in sorted(templates.items())])
    nothing = F.array().cast("array<struct<dice:double,name:string>>")
    rows = rows.select("id", "g", "possible", F.when(some, found).otherwise(nothing).alias("in_blocks"))
    new = F.exists("possible", lambda x: ~F.exists("in_blocks", lambda y: y["name"] == x["name"]))
    windows = F.when(new, _windows(F.col("g"), F.col("possible"), threshold))
    windows = F.filter(windows, lambda x: ~F.exists("in_blocks", lambda y: y["name"] == x["name"]))
    windows = F.coalesce(windows, F.array().cast("array<struct<dice:double,name:string,lo:int,hi:bigint>>"))
    parts = rows.select("id", "in_blocks", windows.alias("windows"))
    once = F.transform(F.array_distinct(F.transform("windows", lambda x: x["name"])), lambda n: F.struct(F.array_max(F.transform(F.filter("windows", lambda x: x["name"] == n), lambda x: x["dice"])).alias("dice"), n.alias("name")))
    hits = parts.select("id", F.concat("in_blocks", once).alias("found"))
    best = F.array_max(F.transform(F.col("found"), lambda x: x["dice"]))
    name = F.array_min(F.transform(F.filter(F.col("found"), lambda x: x["dice"] == best), lambda x: x["name"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.col("found"), lambda x: x["name"]))), ",")
    return hits.select(F.col("id").alias(id_col), name.alias("license"), F.round(best, 6).alias("dice"), names.alias("licenses"), F.size("found").cast("long").alias("n_matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence, its Dice coefficient and all licences found in every row of documents."""
    return license_scan(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    templates = ", ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams(text))}])" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH templates(name, own) AS (VALUES {templates}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
b AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(block, '[^a-z0-9]+', ' ', 'g')) AS block
  FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS block FROM d
    UNION ALL SELECT doc_id, unnest(string_split_regex(t, '\\n[ \\t\\r]*\\n')) FROM d
    UNION ALL SELECT doc_id, t FROM d
  )
),
w AS (SELECT doc_id, block, string_split(block, ' ') AS words FROM b),
g AS (SELECT doc_id, block, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM w),
s AS (
  SELECT doc_id, block, name, 2.0 * len(list_intersect(g.own, templates.own)) / (len(g.own) + len(templates.own)) AS dice
  FROM g JOIN templates ON len(g.own) BETWEEN ceil(len(templates.own) * {THRESHOLD} / {2 - THRESHOLD} - 1e-9) AND floor(len(templates.own) * {2 - THRESHOLD} / {THRESHOLD} + 1e-9)
),
f AS (SELECT doc_id, name, CAST(dice AS DOUBLE) AS dice FROM s WHERE dice >= {THRESHOLD}),
r AS (
  SELECT doc_id, arg_min(name, struct_pack(a := -dice, b := name)) AS license, round(max(dice), 6) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_matches
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches FROM d LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()
