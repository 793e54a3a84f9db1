"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, copyright notices out, punctuation and white space to single spaces,
equivalent spellings to one. Its SHA-256 is looked up among the digests of known licences by a hash join: entire texts
for licence files, and lines that mention a licence for notices inside other texts. Expressions of Spark only.
Licences are known by their full texts with and without headings and appendices, and in their usual numberings.

Defined cases: null and empty texts have the digest of the empty text and match no licence. A licence that is known by
several texts has several digests; texts of several licences with one canonical form give the smallest identifier.
Repeated rows give a row each, an empty table none. Other columns are not read.
"""

from __future__ import annotations

import functools
import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, text_or_empty

# Equivalent spellings, the first of each pair is written as the second.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("minimise", "minimize"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("https", "http"),
]

# Texts of licences and notices, by identifier.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

# What stands above a licence.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License", "BSD-3-Clause"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "Zlib"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Wordings in use besides those of KNOWN, by licence.
WORDINGS = {
    "MIT": [{"this permission notice shall": "this permission notice (including the next paragraph) shall"}],
    "BSD-3-Clause": [{"names of its contributors": "names of contributors"}, {"name of the copyright holder": "name of the University", "THE COPYRIGHT HOLDERS AND": "THE REGENTS AND", "THE COPYRIGHT HOLDER OR": "THE REGENTS OR"}],
}
# Texts in license_texts, the lines that their heading ends with (the last one, copyright lines apart),
# and those that begin an appendix.
WHOLE = {
    "Apache-2.0": (r"www\.apache\.org/licenses/$", r"END OF TERMS AND CONDITIONS$|APPENDIX: "), "Artistic-1.0-Perl": (r"\"Artistic License\"$", None),
    "CC0-1.0": (r"Legal Code$|CC0 1\.0 Universal$|HEREUNDER\.$", None), "GFDL-1.2": (r"not allowed\.$", "ADDENDUM: "), "GFDL-1.3": (r"not allowed\.$", "ADDENDUM: "),
    "GPL-1.0": (r"not allowed\.$", "Appendix: How to Apply"), "GPL-2.0": (r"not allowed\.$", "How to Apply"), "GPL-3.0": (r"not allowed\.$", "How to Apply"),
    "LGPL-2.0": (r"version 2 of the ordinary GPL\.\]$", "How to Apply"), "LGPL-2.1": (r"the version number 2\.1\.\]$", "How to Apply"), "LGPL-3.0": (r"not allowed\.$", None),
    "MPL-1.1": (r"---$", "EXHIBIT A"), "MPL-2.0": (r"=====$", "Exhibit A "),
}
# Addresses of the Free Software Foundation, one of which its older texts bear throughout.
ADDRESS = r"51 Franklin St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA", "<https://fsf.org/>"]


def _short_forms() -> list[tuple[str, str]]:
    """The licences of KNOWN with headings, and with clauses that have numbers, letters or bullets."""
    out = []
    for id_, body in KNOWN:
        if id_ not in HEADINGS or len(body) < 300:
            continue
        bodies = [body, *(functools.reduce(lambda x, pair: x.replace(*pair), w.items(), body) for w in WORDINGS.get(id_, []))]
        if re.search(r"(?m)^1\. ", body):
            bodies += [re.sub(r"(?m)^[0-9]\. ", "* ", x) for x in bodies] + [re.sub(r"(?m)^([0-9])\. ", lambda m: "abc"[int(m[1]) - 1] + ") ", x) for x in bodies]
        out += [(id_, x) for x in bodies[1:]]
        out += [(id_, f"{h}\n\n{x}") for x in bodies for h in HEADINGS[id_]]
    return out


def _whole_forms() -> list[tuple[str, str]]:
    """The texts of WHOLE with and without their headings and appendices. Copyright lines are out, as in canonical()."""
    out = []
    for id_, (above, below) in WHOLE.items():
        text = pkgutil.get_data(__package__, f"license_texts/{id_}.txt").decode()
        text = re.sub(r"(?mi)^ *copyright *\(c\).*\n|^[\W_]*all rights reserved\.$", "", text)
        filled = re.sub(r"(?m)^ *Copyright \[yyyy\].*\n", "", text)  # a file in which the form has a year is without that line
        forms = [text] if filled == text else [text, filled]
        forms += [re.sub(ADDRESS, a, text) for a in ADDRESSES] if re.search(ADDRESS, text) else []
        for x in forms:
            starts = [0, *(m.end() for m in re.finditer(f"(?m){above}", x[:1500]))] if x in (text, filled) else [0]
            ends = [len(x), *(m.start() for m in re.finditer(f"(?m)^ *(?:{below})", x))] if below else [len(x)]
            out += [(id_, x[a:b].strip()) for a in starts for b in ends]
    return out


KNOWN += _short_forms() + _whole_forms()

#: Registries of up to so many rows are also held as a map, for notices.
NOTICES = 1000
# Copyright notices at the beginning of a line, in lower case: the sign or a year, then the holder. A notice is the whole
# line if that has few more words, and else ends with its first sentence or a link in angle brackets, and words on
# rights reserved after it; without such an end the line stays. A name may also stand before the year that ends a line;
# a word of one or two letters there (in 1998) makes it prose.
_GAP, _END, _RIGHTS = r"[ \t\r]+", r"[^\n\p{L}\p{N}]*(?:\z|\n)", r"(?:[ \t\r]+all rights reserved\.*)?"
_SIGNED, _DATED = r"(?:copyright[ \t:]*(?:\(c\)|©)|\(c\) ?[0-9]{4}|©)", r"copyright[ \t:,]*(?:by[ \t]+)?[0-9]{4}"
_WORD = r"(?:[^ \t\r\n]*[^ \t\r\n.]|(?:inc|ltd|co|corp|llc|gmbh|jr|sr|al|dr|[^ \t\r\n.])\.+)"
_NAME = r"(?:[^ \t\r\n<]*[^ \t\r\n.<]|[^ \t\r\n.<]\.+)"


def _notice(head: str, line: int, sentence: int) -> str:
    """head and its line, of so many more words at most, or its sentence."""
    whole = rf"(?:{_GAP}{_WORD}){{0,{line}}}\.*{_RIGHTS}{_END}"
    last = rf"(?:\.+|(?:{_GAP}{_NAME}){{0,{sentence}}}?(?:{_GAP}[^ \t\r\n<]*[^ \t\r\n.<]{{2}}\.+|{_GAP}<[^ \t\r\n>]+>\.*))"
    return rf"{head}[^ \t\r\n.]*(?:{whole}|{last}(?:{_GAP}(?:inc|ltd|llc|gmbh)\.+)?(?:{_GAP}<[^ \t\r\n>]+>\.*)?{_RIGHTS}{_GAP})"


_LATE = rf"copyright(?:{_GAP}[^ \t\r\n]+){{0,4}}{_GAP}[^ \t\r\n]{{3,}}{_GAP}[0-9]{{4}}[0-9, \t–-]*\.*{_RIGHTS}{_END}"
#: Copyright notices, and what stands between words.
COPYRIGHT = rf"(?:^|\n)[^\n\p{{L}}\p{{N}}]*(?:(?:{_notice(_SIGNED, 24, 12)}|{_notice(_DATED, 10, 8)})+|{_LATE}|all rights reserved\.?{_END})"
BETWEEN = r"[^\p{L}\p{N}]+"
#: Lines that can be notices.
MENTIONS = r"(?i)licen[cs]e|public domain|copyright"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(text)
    # Line ends are doubled, so that notices on consecutive lines don't share one.
    lines = F.replace(out, F.lit("\n"), F.lit("\n\n"))
    marked = F.when(out.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(lines, COPYRIGHT, "\n")).otherwise(out)
    # Words are looked up one by one, so that neighbours don't share the space between them; then pairs of words.
    spelled = F.create_map([F.lit(x) for pair in SPELLINGS if " " not in pair[0] for x in pair])
    words = F.transform(F.split(F.trim(F.regexp_replace(marked, BETWEEN, " ")), " "), lambda w: F.coalesce(F.element_at(spelled, w), w))
    out = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    for given, kept in SPELLINGS:
        if " " in given:
            out = F.replace(out, F.lit(f" {given.replace(' ', '  ')} "), F.lit(f" {kept.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_digest and license_id of known texts, one row for each digest."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, n_known: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, license_id of the entire text (null: none) and of lines that are notices (comma-separated).

    known: as of registry(), n_known rows; up to BROADCAST_ROWS (some 80 bytes each) it is broadcast.
    """
    known = F.broadcast(known) if n_known <= BROADCAST_ROWS else known
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    lines = F.when(F.col("text").rlike(MENTIONS), F.filter(F.split("text", "\n"), lambda x: x.rlike(MENTIONS)))
    rows = rows.select("doc_id", digest(F.col("text")).alias("license_digest"), F.transform(lines, digest).alias("lines"))
    found = rows.join(known, "license_digest", "left")
    if n_known <= NOTICES:  # a small registry is a map in the expression, and notices need no join by line
        by = {r["license_digest"]: r["license_id"] for r in known.collect()}
        entries = F.create_map([F.lit(x) for pair in sorted(by.items()) for x in pair])
        of_line = F.array_compact(F.transform("lines", lambda x: F.element_at(entries, x)))
        found = found.withColumn("notice_ids", F.array_join(F.array_sort(F.array_distinct(of_line)), ","))
    else:
        of_line = rows.select("doc_id", F.explode(F.array_distinct("lines")).alias("license_digest")).join(known, "license_digest")
        ids = of_line.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notice_ids"))
        found = found.join(ids, "doc_id", "left")
    return found.select("doc_id", F.col("license_digest").alias("text_digest"), "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"))


def scan_known(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    known = KNOWN if known is None else known
    rows = registry(docs.sparkSession, known)
    if len(known) <= NOTICES:  # digests only, so that the texts are read once
        rows = docs.sparkSession.createDataFrame(rows.collect(), rows.schema)
    return scan(docs, rows, len(known))
