"""Licence scan by canonical digest lookup.

A text is made canonical: ASCII letters lowered, copyright lines and the words
"all rights reserved" dropped, punctuation and whitespace folded to one space,
equivalent spellings replaced, ends trimmed.  Its SHA-256 is hash-joined to the
digests of known licences; whole texts are compared, never parts.

Edge cases: null text counts as empty, and an empty canonical text matches
nothing; repeated rows each get a result; licences with one canonical text are
listed together, sorted and joined by a comma.  Only doc_id and text are read, so
extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copyright lines, after lowering: a mark or a year must follow the word.
COPYRIGHT = r"(?m)^[^\n\pL\pN(©]*(?:copyright[\t ]*(?:\(c\)|©|<|\[|[0-9]{4})|\(c\)[\t ]|©)[^\n]*$"
RESERVED = r"all rights reserved"
OTHER = r"[^\pL\pN]+"
#: Equivalent spellings, applied to whole words of the folded text, in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("copyright owner", "copyright holder"),
    ("noninfringement", "non infringement"), ("merchantibility", "merchantability"), ("analogue", "analog"),
    ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("wilful", "willful"),
    ("programme", "program"), ("behaviour", "behavior"), ("honour", "honor"), ("labour", "labor"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"""
#: Public licence texts; more can be passed as a table.
KNOWN = {
    "MIT": "MIT License\nCopyright (c) 2020 A\n" + _MIT, "MIT-body": _MIT, "ISC": "ISC License\n" + _ISC, "ISC-body": _ISC,
    "Zlib": _ZLIB, "Apache-2.0-header": _APACHE_HEADER, "0BSD": _ZERO_BSD, "BSL-1.0-header": _BOOST,
    "SPDX-MIT": "SPDX-License-Identifier: MIT", "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
}


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern in (COPYRIGHT, RESERVED, OTHER):
        t = F.regexp_replace(t, pattern, " ")
    # Every word gets a space of its own on both sides, so neighbours can both match.
    t = F.replace(F.concat(F.lit(" "), F.trim(t), F.lit(" ")), F.lit(" "), F.lit("  "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(F.regexp_replace(t, " +", " "))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical_py(text: str | None) -> str:
    """The same for one text, by the re module; the tests' second opinion."""
    import regex

    t = (text or "").translate(str.maketrans(UPPER, LOWER))

    for pattern in (COPYRIGHT, RESERVED, OTHER):
        t = regex.sub(pattern.replace(r"\pL", r"\p{L}").replace(r"\pN", r"\p{N}"), " ", t)
    for old, new in SPELLINGS:
        t = re.sub(rf"(?<![^ ]){re.escape(old)}(?![^ ])", new, re.sub(" +", " ", t))
    return re.sub(" +", " ", t).strip(" ")


def digest_py(text: str | None) -> str:
    return hashlib.sha256(canonical_py(text).encode()).hexdigest()


def known_digests(spark: SparkSession, licenses: DataFrame | None = None) -> DataFrame:
    """(license_id, text) -> (digest, license_id), one row per digest."""
    if licenses is None:
        licenses = spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")
    one = licenses.select("license_id", canonical(F.col("text")).alias("c")).where("c <> '' AND license_id IS NOT NULL")
    return one.groupBy(F.sha2("c", 256).alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, canonical_chars (long), license_id (null: unknown)."""
    c = docs.select("doc_id", canonical(F.col("text")).alias("_c"))
    d = c.select("doc_id", F.sha2("_c", 256).alias("digest"), F.length("_c").cast("long").alias("canonical_chars"))
    return d.join(known_digests(docs.sparkSession, licenses), "digest", "left").select("doc_id", "digest", "canonical_chars", "license_id")


def oracle() -> str:
    by: dict[str, list[str]] = defaultdict(list)
    for k, t in KNOWN.items():
        by[digest_py(t)].append(k)
    values = ", ".join(f"('{d}', '{','.join(sorted(ids))}')" for d, ids in by.items())
    c = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for pattern in (COPYRIGHT, RESERVED, OTHER):
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    c = f"replace(' ' || trim({c}, ' ') || ' ', ' ', '  ')"
    for old, new in SPELLINGS:
        c = f"replace({c}, '{_spaced(old)}', '{_spaced(new)}')"
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
c AS (SELECT doc_id, trim(regexp_replace({c}, ' +', ' ', 'g'), ' ') AS c FROM documents)
SELECT doc_id, sha256(c) AS digest, length(c)::BIGINT AS canonical_chars, known.license_id
FROM c LEFT JOIN known ON known.digest = sha256(c)"""
