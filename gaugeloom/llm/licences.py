"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, typography, equivalent spellings, copyright lines, list
marks, punctuation and white space), and the digest of the whole form is looked up among the digests
of known licences by a hash join. Lines and paragraphs of a text are brought to the same form, and their
digests are looked up in the same table: these are notices within a text. The known table is a fixed, small set, so
broadcasting it is bounded; a folder of further texts can be given.

Defined cases: null is the empty text; an empty canonical form is no licence; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts as their publishers give them, without titles and copyright lines.
_PERMIT = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted'
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"{_PERMIT}.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_THREE + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    'software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org>",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
    "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire "
    "statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
    'works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by '
    'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
    "permissions and limitations under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\n"
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}
#: Strings of which every known text has one, in lower case; only lines and paragraphs that have one are looked up.
MARKS = ("licen", "permission", "redistribution")
#: A line that gives a notice: copyright and something else than words that follow it within a sentence.
_COPYRIGHT = r"(?m)^[ \t*#/;-]*(portions )?(copyright\b(?![ \t]*\r?$|[ \t]+(notice|holder|owner|law|statement|licen[cs]e)s?\b|[ \t]+(and|or|in|to|of)\b)|\(c\))[^\n]*$"
#: (pattern, replacement, strings without all of which it can't match; none: it may always), in this order, on lower-cased text.
STEPS = (
    ("[‘’‛´]", "'", ("‘", "’", "‛", "´")), ("[“”„«»]", '"', ("“", "”", "„", "«", "»")), ("[‐‑‒–—]", "-", ("‐", "‑", "‒", "–", "—")), ("©", "(c)", ("©",)),
    (_COPYRIGHT, " ", ("copyright", "(c)")),
    (r"(?m)^[ \t*#/;-]*all rights reserved[.]?[ \t\r]*$", " ", ("all rights reserved",)),
    (r"(?m)^[ \t*#/;-]*the mit license( \(mit\))?[ \t\r]*$|^[ \t*#/;-]*mit license[ \t\r]*$|^[ \t*#/;-]*isc license[ \t\r]*$", " ", ("license",)),
    (r"https?://", " ", ("://",)), (r"(?m)^[ \t*#/;-]*(\(?[0-9a-h][.)]|[*-])[ \t]+", " ", ()),
    (r"\bsub[- ]?licen[cs]e\b", "sublicence", ("license", "licence")), (r"\b(license)(d|s|e|es)?\b", "licence$2", ("license",)),
    (r"\b(fav|col|hon|lab)or\b", "$1our", ("favor", "color", "honor", "labor")), (r"\backnowledgment\b", "acknowledgement", ("acknowledgment",)),
    (r"\bnon[- ]?infringement\b", "noninfringement", ("infringement",)), (r"\bcopyright (owner|holder)\b", "copyright holder", ("copyright ",)),
    (r"\b(authors?|contributors?)\(s\)", "$1", ("(s)",)), (r"\bper cent\b", "percent", ("per cent",)), ("[^a-z0-9\u0080-\U0010ffff]+", " ", ()),
)

#: The SQL keeps the patterns it was given, in the syntax that Java and RE2 share. It is right for texts in which no line within a sentence begins with copyright, and none has "sub-license".
_SQL_PATTERNS = {
    _COPYRIGHT: r"(?m)^[ \t*#/;-]*(portions )?(copyright( \(c\))?|\(c\))[ :,]*[0-9 ,-]*[^\n]*$",
    r"\bsub[- ]?licen[cs]e\b": r"\b(license)(d|s|e|es)?\b", r"\b(license)(d|s|e|es)?\b": r"\bsub[- ]?license\b",
}
_SQL_REPLACEMENTS = {r"\bsub[- ]?licen[cs]e\b": "licence$2", r"\b(license)(d|s|e|es)?\b": "sublicence"}


def _step(form: Column, pattern: str, replacement: str, needs: tuple[str, ...]) -> Column:
    done = F.regexp_replace(form, pattern, replacement)
    if not needs:
        return done
    there = form.contains(needs[0])
    for s in needs[1:]:
        there = there | form.contains(s)
    return F.when(there, done).otherwise(form)


def _bound(step: tuple):
    return lambda x: _step(x, *step)


def canonical(text: Column) -> Column:
    """The canonical form of a whole text. A pattern runs only on texts with a string that it needs, which changes no result."""
    form = F.lower(F.coalesce(text, F.lit("")))
    for step in STEPS:  # an array of one binds the form, so it is not repeated in the expression
        form = F.transform(F.array(form), _bound(step)).getItem(0)
    return F.trim(form)


def read_known(spark: SparkSession, folder: str) -> DataFrame:
    """(licence, known_text) of the text files of a folder, named by their file names without ending: for whole licences beyond KNOWN."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:[.]txt)?$", 1).alias("licence"), F.col("value").alias("known_text"))
    return files


def known_digests(spark: SparkSession, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """licence, digest: one row a known licence; of two with equal forms the first by name counts."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(sorted((known or KNOWN).items()), "licence string, known_text string")
    forms = rows.select("licence", F.sha2(F.encode(canonical(F.col("known_text")), "UTF-8"), 256).alias("digest"))
    return forms.groupBy("digest").agg(F.min("licence").alias("licence"))


def _marked(text: Column) -> Column:
    low = F.lower(text)
    found = low.contains(MARKS[0])
    for m in MARKS[1:]:
        found = found | low.contains(m)
    return found


def parts_of(text: Column, every: bool = False) -> Column:
    """Digests of the lines and paragraphs of a text that have one of MARKS (``every``: of all)."""
    pieces = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \\t\\r]*\n")))
    pieces = pieces if every else F.filter(pieces, _marked)
    forms = F.filter(F.transform(pieces, canonical), lambda x: x != "")
    digests = F.array_distinct(F.transform(forms, lambda x: F.sha2(F.encode(x, "UTF-8"), 256)))
    return digests if every else F.when(_marked(text), digests)


def scan(documents: DataFrame, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, digest of the canonical form, the licence that the whole text is (null: none), and the known texts that its lines and paragraphs are (notices, sorted and joined by commas; "" for none), for every document."""
    table = known_digests(documents.sparkSession, known)
    docs = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), canonical(F.col("text")).alias("form"), parts_of(F.col("text"), known is not None).alias("parts"))
    docs = docs.select("doc_id", "n_chars", F.sha2(F.encode("form", "UTF-8"), 256).alias("digest"), (F.length("form") > 0).alias("filled"), "parts")
    found = docs.join(F.broadcast(table), "digest", "left")
    found = found.withColumn("named", table.agg(F.map_from_entries(F.collect_list(F.struct("digest", "licence")))).scalar())
    notices = F.filter(F.transform("parts", lambda d: F.try_element_at(F.col("named"), d)), lambda x: x.isNotNull())
    return found.select("doc_id", "n_chars", "digest", F.when(F.col("filled"), F.col("licence")).alias("licence"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(notices)), ","), F.lit("")).alias("notices"))


def oracle_sql(known: dict[str, str] | None = None) -> str:
    """The scan in DuckDB's SQL, over the view ``documents``, with the patterns told at _SQL_PATTERNS."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        for pattern, replacement, _ in STEPS:
            pattern, replacement = _SQL_PATTERNS.get(pattern, pattern), _SQL_REPLACEMENTS.get(pattern, replacement)
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
        return f"trim({out}, ' ')"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted((known or KNOWN).items()))
    marked = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in MARKS) + ")"
    return f"""
WITH known AS (SELECT sha256({form('t')}) AS digest, min(l) AS licence FROM (VALUES {rows}) k(l, t) GROUP BY 1),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (SELECT DISTINCT rn, unnest(string_split(text, chr(10)) || regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS piece FROM docs WHERE {marked('text')}),
hits AS (SELECT rn, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT rn, {form('piece')} AS form FROM pieces WHERE {marked('piece')}) p JOIN known ON digest = sha256(form) WHERE form <> '' GROUP BY rn),
forms AS (SELECT rn, doc_id, length(text)::BIGINT AS n_chars, {form('text')} AS form FROM docs)
SELECT d.doc_id, d.n_chars, sha256(d.form) AS digest, CASE WHEN d.form <> '' THEN k.licence END AS licence, coalesce(h.notices, '') AS notices
FROM forms d LEFT JOIN known k ON k.digest = sha256(d.form) LEFT JOIN hits h ON h.rn = d.rn
"""
