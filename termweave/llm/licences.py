"""Licence scans in DataFrame functions only.

Texts and templates are normalised (lower case, words of ASCII letters and digits), cut into sets of word
bigrams and compared by the Dice coefficient. Units are the lines of a document, its paragraphs of several
lines (parted by lines without words) and the document as a whole; scan_runs() takes all runs of lines. A unit meets only those templates whose size bounds allow the threshold; before that, units
without any of the words that a match must have are left out. Templates are a short fixed list and become a literal of the plan; units never leave their row, so
nothing is shuffled.

Where several templates reach the threshold, the greatest coefficient wins: licences that differ by a word or a version have templates of
their own, so that each of them is told by the bigrams that the other lacks. A first sentence that several licences of a family share is a template by
itself and is reported as the family (BSD).

Defined results: null and empty texts, and lines without words, match nothing; a unit of one word has
that word as its only bigram; ties between templates go to the name that sorts first; repeated rows give
repeated rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, lower_ascii, table

#: Notices by which texts are put under public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8
#: Letters from which a word seldom stands in texts that are no licence.
LONG_WORD = 7

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_END = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
#: Whole licence and notice texts, and the grants that often stand alone, for runs of lines.
TEXTS = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_END}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}"),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-2.0", f"{_GPL.format(2)} {_GPL_END}"),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", f"{_GPL.format(3)} {_GPL_END}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_KEEP} {_WARRANTY}"),
    ("AGPL-3.0", _GPL.format(3).replace("GNU General", "GNU Affero General")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", _GPL.format(3).replace("GNU General", "GNU Lesser General")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE} {_UNLICENSE_END} {_WARRANTY}"),
    ("Zlib", _ZLIB),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items()),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def bigrams(text: Column) -> Column:
    """The set of word bigrams of a text."""
    return F.get(F.transform(F.array(_words(text)), _pairs), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), "[^a-z0-9]+"), "")


def _pairs(w: Column) -> Column:
    n = F.size(w)
    return F.when(n <= 1, w).otherwise(F.array_distinct(F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))))


def markers(known: list[tuple[str, list[str], int]], threshold: float) -> list[str]:
    """Patterns of which every unit that reaches the threshold matches one, in its lower-case text: long words, or two short ones beside each other.

    Such a unit shares at least threshold / 2 * (1 + low) of a template's bigrams, so among any more than the
    rest one is shared. Long words are taken by how many such bigrams they cover, so that a few that a template
    repeats stand for many; what then is still needed are bigrams.
    """
    share = threshold / 2 * (1 + threshold / (2 - threshold))
    words: set[str] = set()
    pairs: set[str] = set()
    for _, grams, size in known:
        covered = [g for g in grams if g in pairs or any(w in words for w in g.split(" "))]
        spare = size - math.ceil(share * size - 1e-9) + 1 - len(covered)
        left = [g for g in grams if g not in covered]
        while spare > 0 and left:
            covers = Counter(w for g in left for w in set(g.split(" ")) if len(w) >= LONG_WORD)
            if covers:
                best = min(covers, key=lambda w: (-covers[w], -len(w), w))
                words.add(best)
                spare, left = spare - covers[best], [g for g in left if best not in g.split(" ")]
            else:
                left.sort(key=lambda g: (-len(g), g))
                pairs.add(left.pop(0))
                spare -= 1
    words = {w for w in words if not any(v != w and v in w for v in words)}  # letters and digits only
    return sorted(words | {"[^a-z0-9]+".join(g.split(" ")) for g in pairs})


def _any_of(patterns: list[str]) -> str:
    """A pattern for any of these in either case, by first letters, so that a place is tried once for each letter."""
    by: dict[str, list[str]] = {}
    for w in patterns:
        by.setdefault(w[0], []).append(w[1:])
    return "(?i)" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items()))


#: Parts paragraphs.
BLANK = f"\\n(?:[{SEPARATORS}]*\\n)+"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each unit that reaches the threshold: key, unit (line, paragraph, text), number (from 0, of its kind), licence, dice.

    A document of one line is that line alone, one of one paragraph that paragraph's lines and the whole text.
    """
    names = sorted(set(templates or [*TEMPLATES.items(), *TEXTS]))
    spark = docs.sparkSession
    known = spark.createDataFrame(names, "licence string, notice string").select("licence", bigrams(F.col("notice")).alias("grams")).collect()
    known = [(r.licence, r.grams, len(r.grams)) for r in known if r.grams]
    if not known:
        return docs.select(F.col(key).alias(key), F.lit("").alias("unit"), F.lit(0).alias("number"), F.lit("").alias("licence"), F.lit(0.0).alias("dice")).filter(F.lit(False))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    marked = lambda c: c.rlike(_any_of(markers(known, threshold)))
    t = F.coalesce(F.col(text), F.lit(""))
    lines, parts = F.split(F.col("t"), "\n"), F.split(F.col("t"), BLANK)
    unit = lambda kind, number, x: F.struct(F.lit(kind).alias("unit"), number.alias("number"), x.alias("part"))
    several = lambda u: u["part"].contains("\n")
    none = F.array().cast("array<struct<unit:string,number:int,part:string>>")
    of_lines = F.transform(lines, lambda x, i: unit("line", i, x))
    of_parts = F.when(F.size(parts) > 1, F.filter(F.transform(parts, lambda x, i: unit("paragraph", i, x)), several)).otherwise(none)
    whole = F.when(F.size(lines) > 1, F.array(unit("text", F.lit(0), F.col("t")))).otherwise(none)
    cut = docs.select(F.col(key).alias(key), t.alias("t")).filter(marked(F.col("t"))).select(key, F.inline(F.concat(of_lines, of_parts, whole))).filter(marked(F.col("part")))
    cut = cut.select(key, "unit", "number", bigrams(F.col("part")).alias("grams"))
    n = F.size("grams")

    def dice(order: int, name: str, grams: list[str], size: int) -> Column:
        shared = F.size(F.array_intersect(F.col("grams"), F.array(*map(F.lit, grams))))
        value = F.when(n.between(F.lit(size * low), F.lit(size * high)), 2 * shared / (n + size))
        return F.when(value >= threshold, F.struct(value.alias("dice"), F.lit(order).alias("order"), F.lit(name).alias("licence")))

    # the greatest by dice, then the name that sorts first: templates are in reverse order of names
    best = F.array_max(F.array(*[dice(k, *x) for k, x in enumerate(reversed(known))]))
    found = cut.select(key, "unit", "number", F.explode(F.array(best)).alias("best")).filter(F.col("best").isNotNull())
    return found.select(key, "unit", "number", F.col("best.licence").alias("licence"), F.round("best.dice", 6).alias("dice"))


def scan_runs(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each run of lines that reaches the threshold: key, first and last line (from 0), licence, dice.

    Units are all runs of consecutive lines that begin and end with a line that has a bigram of the template (bigrams
    over a line's end are of both lines), so lines, paragraphs and whole texts too. Of the runs of a template
    that begin at one line the best counts, and of those that share lines, of any
    template, the best one: by dice times shared bigrams (so that a whole text comes before a sentence of it), fewer
    lines, the licence's name, the first line.

    Only documents that hold enough of a template's bigrams, anywhere, are cut into runs. A run
    would be better without a line at its ends that has none of them; it grows only while its distinct bigrams are
    within the template's size bounds.
    """
    spark = docs.sparkSession
    names = sorted(set(templates or [*TEMPLATES.items(), *TEXTS]))
    known = spark.createDataFrame(names, "licence string, notice string").select("licence", bigrams(F.col("notice")).alias("grams")).filter(F.size("grams") > 0).withColumn("size", F.size("grams"))
    told = [(r.licence, r.grams, r["size"]) for r in known.collect()]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    share = threshold / 2 * (1 + low)
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key).alias("__key"), t.alias("t"))
    cut = cut.filter(F.col("t").rlike(_any_of(markers(told, threshold)))) if told else cut
    # lines with words, their numbers, and all bigrams of the text
    lines = F.filter(F.transform(F.split(F.col("t"), "\n"), lambda x, i: F.struct(i.alias("line"), _words(x).alias("w"))), lambda x: F.size(x["w"]) > 0)
    cut = cut.select("__key", F.monotonically_increasing_id().alias("row"), lines.alias("l")).withColumn("all", F.get(F.transform(F.array(F.flatten(F.col("l.w"))), _pairs), F.lit(0)))
    cut = cut.join(F.broadcast(known)).filter(F.size(F.array_intersect("all", "grams")) >= share * F.col("size") - 1e-9).drop("all")
    own = F.transform(F.col("l.w"), lambda w: F.when(F.size(w) > 1, _pairs(w)).otherwise(F.array().cast("array<string>")))
    # bigrams over a line's end count with both of its lines
    ahead = F.transform(F.col("l.w"), lambda w, i: F.concat(w, F.coalesce(F.slice(F.get(F.col("l.w"), i + 1), 1, 1), F.array().cast("array<string>"))))
    behind = F.transform(F.col("l.w"), lambda w, i: F.concat(F.when(i > 0, F.slice(F.get(F.col("l.w"), i - 1), -1, 1)).otherwise(F.array().cast("array<string>")), w))
    touched = lambda c: F.transform(c, lambda w: F.arrays_overlap(_pairs(w), F.col("grams")))
    cut = cut.select("*", own.alias("own"), touched(ahead).alias("opens"), touched(behind).alias("closes"))
    cut = cut.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("opens", i))))
    # lines from i on that keep within the bounds: a full state no longer grows
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def grow(a: Column, g: Column) -> Column:
        both = F.when(a["full"], a["seen"]).otherwise(F.array_union(a["seen"], g))
        return F.get(F.transform(F.array(both), lambda s: F.struct(s.alias("seen"), (a["n"] + F.when(a["full"] | (F.size(s) > F.col("size") * high), 0).otherwise(1)).alias("n"), (a["full"] | (F.size(s) > F.col("size") * high)).alias("full"))), F.lit(0))

    cut = cut.withColumn("n_lines", F.aggregate(F.slice("own", F.col("i") + 1, F.size("own")), start, grow)["n"]).filter("n_lines > 0")
    cut = cut.withColumn("j", F.explode(F.filter(F.sequence(F.col("i"), F.col("i") + F.col("n_lines") - 1), lambda j: F.get("closes", j))))
    unit = F.flatten(F.slice(F.col("l.w"), F.col("i") + 1, F.col("j") - F.col("i") + 1))
    cut = cut.withColumn("g", F.get(F.transform(F.array(unit), _pairs), F.lit(0)))
    cut = cut.select("*", (2 * F.size(F.array_intersect("g", "grams")) / (F.size("g") + F.col("size"))).alias("dice")).filter(F.col("dice") >= threshold)
    line = lambda c: F.get(F.col("l.line"), F.col(c))
    # orders by its fields, the least first; in whole units, so that ties are ties
    order = F.struct((-F.round(F.col("dice") * F.size(F.array_intersect("g", "grams")) * 1e6).cast("long")).alias("worse"), (line("j") - line("i")).alias("more"), F.col("licence"), line("i").alias("first_line"), line("j").alias("last_line"), F.col("dice"))
    best = cut.groupBy("row", "grams", "i").agg(F.first("__key").alias("__key"), F.min(order).alias("o"))
    runs = best.groupBy("row").agg(F.first("__key").alias(key), F.array_distinct(F.collect_list("o")).alias("o"))
    alone = F.filter("o", lambda x: ~F.exists("o", lambda y: (y < x) & (y["first_line"] <= x["last_line"]) & (x["first_line"] <= y["last_line"])))
    found = runs.select(key, F.explode(alone).alias("o"))
    return found.select(key, "o.first_line", "o.last_line", "o.licence", F.round("o.dice", 6).alias("dice"))


def op10_licence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_runs(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in sorted({*TEMPLATES.items(), *TEXTS}))


_GRAMS = "case when len(w) <= 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end"
ORACLE_SQL = f"""
with t as (select licence, list_filter(string_split_regex(lower(notice), '[^a-z0-9]+'), lambda x: x <> '') w from (values {_values()}) v(licence, notice)),
known as (select licence, {_GRAMS} g from t),
texts as (select doc_id, coalesce(text, '') text, string_split(coalesce(text, ''), chr(10)) l, string_split_regex(coalesce(text, ''), '{BLANK}') p from documents),
units as (select doc_id, 'line' unit, unnest(range(0, len(l))) number, unnest(l) part from texts
  union all select * from (select doc_id, 'paragraph', unnest(range(0, len(p))), unnest(p) part from texts where len(p) > 1) where contains(part, chr(10))
  union all select doc_id, 'text', 0, text from texts where len(l) > 1),
words as (select doc_id, unit, number, list_filter(string_split_regex(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') w from units),
grams as (select doc_id, unit, number, {_GRAMS} g from words where len(w) > 0),
scored as (select doc_id, unit, number, licence, 2 * len(list_intersect(grams.g, known.g)) / (len(grams.g) + len(known.g)) dice
  from grams join known on len(grams.g) between len(known.g) * {THRESHOLD / (2 - THRESHOLD)!r} and len(known.g) * {(2 - THRESHOLD) / THRESHOLD!r})
select doc_id, unit, cast(number as integer) number, licence, round(dice, 6) dice from scored where dice >= {THRESHOLD}
qualify row_number() over (partition by doc_id, unit, number order by dice desc, licence) = 1"""
