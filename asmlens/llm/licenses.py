"""Licence scan by canonical digests. DataFrame and SQL functions only.

A text is made canonical: small letters, typographic quotes and dashes as plain
ones, copyright lines and list marks at line starts left out, equivalent
spellings made one, every run of ASCII punctuation and white space one space,
and a title before the licence left out. Comment marks are punctuation. The MD5
digest of the whole canonical text is hash-joined to the digests of known
licences; digests of single lines are looked up in the same catalogue, for
notices inside other text. The catalogue is the constant below, so it is
broadcast; one scan does all, without a shuffle, and a licence that a third of
all documents share meets none.

Cases: null text counts as empty and has no licence. Every row has one result,
rows that repeat each their own. Null ids are kept. Texts and lines of any length
are digested whole. An empty table gives an empty table. Other columns, also
such with the names of the outputs, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    _AS_IS + " AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

# Public licence notices and texts, in their usual wording.
CATALOGUE = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_TAIL),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law.\n\n"
        + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
        "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE "
        "LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)

# Digests of the canonical form of long public licences, as published by their authors.
DIGESTS = (
    ("Apache-2.0", "5a157e7749ac7d8ec8cee596b1c5e099"),
    ("Artistic-1.0-Perl", "6abc428af45281a1531ed1fb0263c579"),
    ("CC0-1.0", "1a2ae468ccae8122ceca54319f482b81"),
    ("GFDL-1.2", "760760f5bc7ac04176b391834ad4bddb"),
    ("GFDL-1.3", "a4a8ea60ad9a51ff5bb75d8dade18d38"),
    ("GPL-1.0", "bac96f35d356fea7c82a4197ef615ccf"),
    ("GPL-2.0", "6f19cd713fc9138b48d5597663ed5c9b"),
    ("GPL-3.0", "f9bef14309cc35eca72b01e8ec5ac5fc"),
    ("LGPL-2.0", "f3e23a0297d5d3bc8b9a0097b832a785"),
    ("LGPL-2.1", "5d02c5aed64e6b95c6deb729e55bb3f1"),
    ("LGPL-3.0", "45ec14853d944805ef573d0b3a40cda3"),
    ("MPL-1.1", "297cbf0479b37c78017155da729296b9"),
    ("MPL-2.0", "4649ce7b072d54aa38f90ce185fa69f4"),
)

# What counts as a copyright line (also behind comment marks), marks of list items, titles, and spellings that count as one.
LINE_START = (
    r"^[ \t#*/;%!>-]*(?:(?:portions )?copyright[ \t]*(?:\(c\)|©|:|[0-9<\[{]|the )[^\n]*|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?[0-9<\[{][^\n]*"
    r"|all rights reserved\.?[ \t\r]*$|\(?[0-9]{1,2}[.)][ \t]+|\(?[a-z]\)[ \t]+)"
)
TITLE = (
    r"^(?:the )?(?:mit license(?: mit)?|isc license(?: isc)?|bsd [0-9] clause(?: simplified| new or revised| new| revised)? license|bsd zero clause license"
    r"|zero clause bsd(?: license)?|0bsd license|unlicense|zlib license|zlib libpng license) "
)
SPELLINGS = (
    ("licence", "license"), ("sublicense", "sub license"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"),
    ("organisation", "organization"), ("recognise", "recognize"), ("authoris", "authoriz"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("whilst", "while"), ("favour", "favor"), ("&", " and "), ("http://", "https://"),
)
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"
TYPOGRAPHIC, PLAIN = "“”„‘’‚–—\u00a0", "\"\"\"'''-- "


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks; a line may have spaces at its ends."""
    out = F.regexp_replace(F.translate(F.lower(text), TYPOGRAPHIC, PLAIN), "(?md)" + LINE_START, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, PUNCTUATION, " ")


def whole(lines: Column) -> Column:
    """One canonical line from canonical lines, without a title before it."""
    return F.regexp_replace(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")), TITLE, "")


def catalogue(spark: SparkSession) -> DataFrame:
    """Rows (digest, license) of the known texts."""
    texts = spark.createDataFrame(list(CATALOGUE), "license string, text string")
    known = texts.select(F.md5(whole(canonical_lines(F.col("text")))).alias("digest"), "license")
    return known.unionByName(spark.createDataFrame(list(DIGESTS), "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_license, line_licenses, n_license_lines): what a document is, and the distinct licences of its lines."""
    known = catalogue(docs.sparkSession)
    names = {r.digest: r.license for r in known.collect()}  # the constant catalogue
    lookup = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    lines = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    found = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.try_element_at(lookup, F.md5(F.trim(x)))), lambda x: x.isNotNull())
    rows = lines.select("doc_id", F.md5(whole(F.col("lines"))).alias("digest"), found.alias("found"))
    out = rows.join(F.broadcast(known.withColumnRenamed("license", "text_license")), "digest", "left")
    return out.select("doc_id", "text_license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"), F.size("found").cast("long").alias("n_license_lines"))


def op9_license_digests(spark, sf_dir: str) -> DataFrame:
    """Every document with its licences."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _duck(text: str) -> str:
    out = f"regexp_replace(translate(lower({text}), {_quoted(TYPOGRAPHIC)}, {_quoted(PLAIN)}), {_quoted('(?m)' + LINE_START)}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g')"


def _duck_whole(lines: str) -> str:
    return f"regexp_replace(trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g')), {_quoted(TITLE)}, '')"


ORACLE = f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT md5({_duck_whole(_duck("text"))}) AS digest, license
    FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in CATALOGUE)}) v(license, text)
    UNION ALL SELECT digest, license FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in DIGESTS)}) v(license, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_duck("coalesce(text, '')")} AS lines FROM documents),
parts AS (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM d),
hits AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n
  FROM (SELECT r, md5(trim(line)) AS digest FROM parts) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, k.license AS text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN hits USING (r) LEFT JOIN known k ON k.digest = md5({_duck_whole("lines")})
"""
