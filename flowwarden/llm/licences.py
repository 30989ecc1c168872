"""Licence scans by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation, white space, equivalent
spellings) and its digest is looked up, whole texts at a time, among the digests of known licences.
The units looked up are each document as a whole, each of its lines, and each run of lines: a wrapped
licence text or a notice in a comment. Only units whose word count and end words are those of a known
text are brought to the canonical form.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .store import session_of, text_of

# Public licence notices and short licence texts.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT-0", "MIT No Attribution\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.\nYou should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
# Equivalent spellings, as whole words of the canonical form.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sublicence", "sublicense"), ("favour", "favor"), ("organisation", "organization"), ("recognise", "recognize"),
    ("modelled", "modeled"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("and or", "and"), ("version", "v"),
)
# Digests of whole licences, with and without what follows their terms: license_id, first and last counted
# word, counted words, words of the canonical form, SHA-256 of the canonical form.
FULL = (
    ("Apache-2.0", "apache", "the", 1446, 1601, "af1666e84adaf85a16e2782befd4c207854987fb51b139559b129bd55eee2b2f"),
    ("Apache-2.0", "apache", "conditions", 1291, 1430, "0b06cd435ba4c81f09f2b539364aa29c3e5477460c0d596945005a603ee4cdd1"),
    ("Apache-2.0", "apache", "liability", 1287, 1425, "0fedb19ff4e39b89bde305077a67cf2bc39b0e541ac0046690dbacc0d568bd91"),
    ("Artistic-1.0-Perl", "the", "end", 936, 983, "4830b8c89ffe1c2d5a0734390441c41e05f2ab57847fd3e8612e425d9af2c2fe"),
    ("CC0-1.0", "creative", "work", 975, 1085, "7c50f8d146355a05dcc888c547df7731cfda904b9136c7ebb28b4559cde2a637"),
    ("GFDL-1.2", "gnu", "software", 3106, 3311, "b94bd2b2feb3762a5a699372b71e3c87f7aafa6f88237429ff477e713cf24840"),
    ("GFDL-1.3", "gnu", "software", 3496, 3728, "e1e1e9eff6c2df25aaeb8c7144b1c6281705591b89805742bb9d7ba0e068b8a5"),
    ("GPL-1.0", "gnu", "it", 1921, 2063, "10e2497b28b815560207db213c49568ccb86629b01d8eaf260bd0d6bd438e687"),
    ("GPL-1.0", "gnu", "conditions", 1514, 1638, "91e9f7c99caa023bc4d43d16cb57939b3a872b0473ecd013dae57721a7ced2a0"),
    ("GPL-1.0", "gnu", "damages", 1510, 1633, "48194f441488ee355ade0bbb0296407f7b7cb6ad412a0087d3f409c9a75e61b9"),
    ("GPL-2.0", "gnu", "this", 2777, 2969, "52e770751bf13818e2fa0a006b413eec0ee9879ecf2c460d78c3a0a09e0ae1d8"),
    ("GPL-2.0", "gnu", "conditions", 2329, 2499, "3d964acaa8f215bf9dff5ea6002ace976af6d1324cea869d0c1f49460a13260d"),
    ("GPL-2.0", "gnu", "damages", 2325, 2494, "e82b090c52b03e90f4af3978c958810d3b52e74c40818f6b35ae174af07f45c3"),
    ("GPL-3.0", "gnu", "html", 5323, 5679, "2ba5e4d8b8aa6243e3f89b53a84ff7af4bd461077643609cb23c7e01eadb5ee5"),
    ("GPL-3.0", "gnu", "conditions", 4903, 5237, "74472ade29526c754830bbdcdc949d5da5aae2014dfb0f70bcd3b60c18362dd2"),
    ("GPL-3.0", "gnu", "fee", 4899, 5232, "c1aeec821b0c1ce78703b25195ec44d4c3dab5c448e58bf1860ebe9a58d317ea"),
    ("LGPL-2.0", "gnu", "it", 3957, 4191, "cdae6bcbd99620c9ab071948cae462742cd9106b8191ed5e2f0e490df546334f"),
    ("LGPL-2.0", "gnu", "conditions", 3639, 3857, "4ccad308daa93af2dc7eca57e752dae8133f1c223b1de9b3d59fc4d4fc43a16c"),
    ("LGPL-2.0", "gnu", "damages", 3635, 3852, "08b19c3decb1b5cbbbabbb34d737b3ba30e0d3415dc073b5af61010d2a9d5432"),
    ("LGPL-2.1", "gnu", "it", 4146, 4392, "cae714fec376f5176ec6c7ddaace97b03f5e13bf1401a3160ffbc924edaea9b1"),
    ("LGPL-2.1", "gnu", "conditions", 3827, 4057, "999016894760f302c620926759908233d6ffa52021fa808c3bbcf57ddd811b29"),
    ("LGPL-2.1", "gnu", "damages", 3823, 4052, "d5d966950b5ffa31e5bcef48615e8e3686d088267507fb7ec68f5cce2497520f"),
    ("LGPL-3.0", "gnu", "library", 1162, 1229, "16435cf72a01b287e49fdd5fb5c1cd436d9778feed54c77b473ddfad7015e7d9"),
    ("MPL-1.1", "mozilla", "modifications", 3498, 3775, "6a24c15d26ed2f862c85f6f7ee08584770d79221da6d732c58b0f2475739e7cb"),
    ("MPL-2.0", "mozilla", "0", 2246, 2426, "d967acc6ac57ac0410b353c5ae5266cdc1affe6b50883a3da362e3028c5c1f19"),
)
_NOTICE = (
    r"^[^a-z0-9\n\x{80}-\x{10FFFF}]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|[<\[{]|by |the )[^\n]*|\(c\)[ \t]*[0-9]{4}[^\n]*"
    r"|\(c\)([ \t]+[^ \t\r\n]+){0,6}[ \t\r]*$|©[^\n]*|all rights reserved[^\n]*)"
)
_MARKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_LINE_NOTICE = re.compile(_NOTICE.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")

Shape = tuple[str | None, str | None, int, int]  # first and last counted word, counted words, words of the canonical form


def _word_classes() -> tuple[dict[str, str], set[str]]:
    """(one spelling per word, words left out of counts), so that no pair of ``SPELLINGS`` changes counted words."""
    pairs = [(a.split(), b.split()) for a, b in SPELLINGS]
    free = {w for a, b in pairs if len(a) != len(b) for w in (*a, *b)}
    same = {x: y for a, b in pairs if len(a) == len(b) for x, y in zip(a, b) if x != y}
    return same, free | {x for x, y in same.items() if y in free}


_SAME, _FREE = _word_classes()


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, words parted by single spaces, one spelling.

    A copyright line begins, behind any comment marks, with "copyright" and a year, sign, bracket, "by" or "the", with
    the sign alone, or with "all rights reserved"; a sentence wrapped before the word "copyright" stays.
    """
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, "(?md)" + _NOTICE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, _MARKS, " "), F.lit(" "))
    for before, after in SPELLINGS:
        out = F.replace(out, F.lit(f" {before} "), F.lit(f" {after} "))
    return F.trim(out)


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, digest) of a table (license_id, text); of equal digests the smallest id counts, empty forms are left out."""
    forms = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    digests = forms.select("license_id", F.sha2("form", 256).alias("digest"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _lines(text: str) -> tuple[list[str], list[int], list[int]]:
    """Counted words of a text, and how many counted words and words stand before each line and at the end."""
    counted, starts, words = [], [0], [0]
    for line in text.lower().split("\n"):
        found = [] if _LINE_NOTICE.match(line) else _WORD.findall(line)
        counted += [_SAME.get(w, w) for w in found if w not in _FREE]
        starts.append(len(counted))
        words.append(words[-1] + len(found))
    return counted, starts, words


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, form in zip(batch.column("text").to_pylist(), batch.column("form").to_pylist()):
            counted = _lines(text)[0]
            rows.append({"first": counted[0] if counted else None, "last": counted[-1] if counted else None,
                         "counted": len(counted), "words": len(form.split(" "))})
        yield pa.RecordBatch.from_pylist(rows, _SHAPE)


_SHAPE = pa.schema([("first", pa.string()), ("last", pa.string()), ("counted", pa.int64()), ("words", pa.int64())])


def _candidates(text: str, shapes: dict[str | None, list[Shape]]) -> Iterator[tuple[int | None, int]]:
    """(first line, last line) of the units of ``text`` that have the shape of a known text; (None, 0) is the text itself.

    Equal canonical forms have equal shapes, and a form of n words comes from n/2 to 2n words, so no match is left out.
    """
    counted, starts, words = _lines(text)
    none = shapes.get(None, [])
    size = len(counted)
    for first, last, count, n in [*(shapes.get(counted[0], []) if counted else []), *none]:
        if count == size and (not count or counted[-1] == last) and n <= 2 * words[-1] and words[-1] <= 2 * n:
            yield None, 0
            break
    if len(starts) == 2:
        return
    full = [i for i in range(len(starts) - 1) if words[i + 1] > words[i]]
    ends: dict[int, list[int]] = {}
    for j in full:
        ends.setdefault(starts[j + 1], []).append(j)
    for i in full:
        begin, found = starts[i], set()
        for first, last, count, n in [*(shapes.get(counted[begin], []) if begin < size else []), *none]:
            stop = begin + count
            if stop in ends and (not count or counted[stop - 1] == last):
                lines = ends[stop]
                low = bisect_left(lines, max(0, words[i] + (n + 1) // 2), key=lambda j: words[j + 1])
                high = bisect_right(lines, words[i] + 2 * n, key=lambda j: words[j + 1])
                found.update(j for j in lines[low:high] if j >= i)
        for j in sorted(found):
            yield i, j


def _units(shapes: dict[str | None, list[Shape]], id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("unit", pa.string()), ("line", pa.int64()), ("last_line", pa.int64()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                lines = None
                for i, j in _candidates(text, shapes):
                    at.append(k)
                    if i is None:
                        rows.append(("text", None, None, text))
                        continue
                    lines = lines or text.split("\n")
                    rows.append(("line" if i == j else "run", i, j, "\n".join(lines[i : j + 1])))
            columns = list(zip(*rows)) if rows else [()] * 4
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    return run


def scan_licences(
    docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = KNOWN, full: Sequence[tuple] = FULL, few: int = 100_000
) -> DataFrame:
    """(doc_id, unit, line, last_line, license_id): units of ``docs`` (doc_id, text) whose canonical digest is known.

    ``unit`` is ``text`` for a whole document (lines NULL), ``line`` for a line of a document of several lines, numbered
    from 0, and ``run`` for several consecutive lines of which the first and last have words. Known are the texts of
    ``known`` and the digests of ``full``. NULL and empty texts match nothing; repeated rows repeat their rows; NULL ids
    are kept. Word counts and end words of the known texts travel with the tasks, so more than ``few`` known
    texts are an error. Empty tables give empty results.
    """
    spark = session_of(docs)
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, text string")
    if table.limit(few + 1).count() > few:
        raise ValueError(f"more than {few} known texts")
    forms = table.select("text", canonical(F.col("text")).alias("form")).where("form <> ''")
    shapes: dict[str | None, list[Shape]] = {}
    shape_rows = forms.mapInArrow(_shapes, "first string, last string, counted long, words long").distinct().collect()
    for shape in sorted({*map(tuple, shape_rows), *(row[1:5] for row in full)}, key=str):
        shapes.setdefault(shape[0], []).append(shape)
    digests = known_digests(table)
    if full:
        fixed = spark.createDataFrame([(row[5], row[0]) for row in full], "digest string, license_id string")
        digests = digests.unionByName(fixed).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    field = docs.schema["doc_id"]
    schema = T.StructType([field]).add("unit", "string").add("line", "long").add("last_line", "long").add("part", "string")
    units = docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(_units(shapes, to_arrow_type(field.dataType)), schema)
    marked = units.select("doc_id", "unit", "line", "last_line", F.sha2(canonical(F.col("part")), 256).alias("digest"))
    return marked.join(F.broadcast(digests), "digest").select("doc_id", "unit", "line", "last_line", "license_id")


def _sql(text: str) -> str:
    """``canonical`` in DuckDB."""
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '(?m){_NOTICE}', '', 'g')"
    out = f"concat(' ', regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' ')"
    for before, after in SPELLINGS:
        out = f"replace({out}, ' {before} ', ' {after} ')"
    return f"trim({out}, ' ')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Runs begin at lines with the first word of a known text and have, line by line, its number of words up to twice that.
ORACLE = f"""WITH t AS (SELECT license_id, {_sql("text")} AS form
   FROM (VALUES {", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in KNOWN)}) v(license_id, text)),
 w AS (SELECT license_id, sha256(form) AS digest, split_part(form, ' ', 1) AS first, len(string_split(form, ' ')) AS words FROM t
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{i}', '{d}', '{a}', {n})" for i, a, _, _, n, d in FULL)}) v),
 k AS (SELECT digest, min(license_id) AS license_id FROM w GROUP BY 1),
 p AS (SELECT row_number() OVER () AS row, doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
 n AS (SELECT row, doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM p WHERE len(parts) > 1),
 l AS (SELECT row, doc_id, n, {_sql("parts[n]")} AS form FROM n),
 c AS (SELECT row, doc_id, n, form, sum(CASE WHEN form = '' THEN 0 ELSE len(string_split(form, ' ')) END) OVER (PARTITION BY row ORDER BY n) AS upto FROM l),
 r AS (SELECT DISTINCT a.row, a.n AS i, b.n AS j FROM (SELECT *, len(string_split(form, ' ')) AS own FROM c WHERE form <> '') a
   JOIN (SELECT DISTINCT first, words FROM w) s ON split_part(a.form, ' ', 1) = s.first
   JOIN c b ON b.row = a.row AND b.n > a.n AND b.form <> '' AND b.upto - a.upto + a.own BETWEEN s.words AND 2 * s.words),
 f AS (SELECT doc_id, 'text' AS unit, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS last_line, {_sql("coalesce(text, '')")} AS form FROM documents
  UNION ALL SELECT doc_id, 'line', n - 1, n - 1, form FROM l
  UNION ALL SELECT doc_id, 'run', i - 1, j - 1, {_sql("array_to_string(parts[i:j], chr(10))")} FROM r JOIN p USING (row))
SELECT doc_id, unit, line, last_line, license_id FROM f JOIN k ON sha256(form) = digest WHERE form <> ''"""
