"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case, statements of copyright gone, equivalent spellings
made one, punctuation, line ends and spaces reduced to single blanks), digested whole, and hash-joined to
the digests of known licence texts and notices. The paragraphs and the lines of a document are texts of their
own, joined in the same way, so a notice at the foot of a document is found, wrapped or not.

A statement of copyright is a line that gives a year, a sign or a place-holder with the word, or says that all
rights are reserved; a line of running text that happens to begin with the word stays. The table of known digests
is broadcast if it has at most BROADCAST rows, else it is dealt like any other. KNOWN has full texts of the
short licences and the notices of the long ones; give `known` for more.

Null or empty text: digest of the empty canonical text, no licence. Repeated rows give repeated rows; ties (two
names for one digest) go to the first name in order. Other columns are not read, whatever their names; an empty table
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts and the usual notices, as published.
KNOWN: list[tuple[str, str]] = [
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"ISC License\n\nCopyright <year> <owner>\n\n{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_PERMIT}.\n\n{_ISC_END}"),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) <year>, <owner>\n\n{_BSD}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"Copyright (c) <year>, <owner>\nAll rights reserved.\n\n{_BSD}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\n\n{_BSD}\n\n{_BSD_THIRD}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"Copyright (c) <year>, <owner>\nAll rights reserved.\n\n{_BSD}\n\n{_BSD_THIRD}\n\n{_BSD_END}"),
    ("MIT-0", """MIT No Attribution

Copyright <year> <copyright holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]

#: A line that states a copyright (lower case): with a year, a sign or a place-holder. RE2 and Java read it alike.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:copyright[ \t:]*(?:\(c\)|©|[<\[{]|[^\n]*\b(?:19|20)[0-9][0-9]\b)[^\n]*|(?:\(c\)|©)[ \t]*(?:copyright|[<\[{]|(?:19|20)[0-9][0-9])[^\n]*|all rights reserved\.?[ \t]*)$"
#: Known digests that are broadcast at most.
BROADCAST = 100_000
#: Equivalent spellings, the first made the second, after lower-casing and blanks.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("noninfringement", "non infringement"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("v", "version"), ("creative commons", "cc"), ("attribution", "by"), ("noncommercial", "nc"), ("sharealike", "sa"), ("https", "http")]


def canonical_lines(text: Column) -> Column:
    """Array of canonical lines; an empty one stays empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " "), "\n", " \n "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.transform(F.split(t, "\n"), lambda x: F.trim(x))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != F.lit("")), " ")


def _parts(lines: Column) -> Column:
    """Texts of the lines, and of the paragraphs (lines between empty ones) of several lines."""
    marked = F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("\n")).otherwise(F.concat(F.lit("\t"), x))), "")
    paragraphs = F.filter(F.transform(F.split(marked, "\n+"), lambda p: F.substring(p, 2, 1 << 30)), lambda p: p.contains("\t"))
    return F.concat(F.filter(lines, lambda x: x != F.lit("")), F.transform(paragraphs, lambda p: F.translate(p, "\t", " ")))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: as many rows as the list has texts, at most."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    return rows.select(F.sha2(_whole(canonical_lines(F.col("text"))), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (of the whole text, or null), line_licenses (of its lines and paragraphs, sorted), n_license_lines (such lines and paragraphs)."""
    digests = written(known_digests(docs.sparkSession, known), "licenses")
    digests = F.broadcast(digests) if len(KNOWN if known is None else known) <= BROADCAST else digests
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2"), canonical_lines(F.col("text")).alias("lines"))
    base = written(base.select("doc_id", "r1", "r2", F.sha2(_whole(F.col("lines")), 256).alias("digest"), F.transform(_parts(F.col("lines")), lambda x: F.sha2(x, 256)).alias("parts")), "digests")
    # equal rows have equal parts: each place of a text counts once
    hits = base.select("r1", "r2", F.posexplode("parts").alias("pos", "digest")).join(digests, "digest").groupBy("r1", "r2", "pos").agg(F.min("license").alias("license"))
    hits = hits.groupBy("r1", "r2").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    found = base.drop("parts").join(digests, "digest", "left").join(hits, ["r1", "r2"], "left")
    return found.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _canon_sql(col: str) -> str:
    t = f"regexp_replace(lower(coalesce({col}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    t = f"' ' || replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"list_transform(string_split({t}, chr(10)), lambda x: trim(x))"


def oracle() -> str:
    known = ", ".join(f"('{_sql(n)}', '{_sql(t)}')" for n, t in KNOWN)
    whole = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    return f"""
WITH k AS (SELECT sha256({whole}) AS digest, min(n) AS license FROM (SELECT n, {_canon_sql('t')} AS lines FROM (VALUES {known}) v(n, t)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canon_sql('text')} AS lines FROM documents),
x AS (SELECT r, unnest(lines) AS x, generate_subscripts(lines, 1) AS p FROM d),
y AS (SELECT r, x, p, count(*) FILTER (x = '') OVER (PARTITION BY r ORDER BY p) AS g FROM x),
t AS (
  SELECT r, x AS t FROM x WHERE x <> ''
  UNION ALL SELECT r, string_agg(x, ' ' ORDER BY p) FROM y WHERE x <> '' GROUP BY r, g HAVING count(*) > 1),
g AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, CAST(count(*) AS BIGINT) AS n FROM t JOIN k ON sha256(t.t) = k.digest GROUP BY r)
SELECT doc_id, w.digest, k.license, coalesce(g.line_licenses, '') AS line_licenses, coalesce(g.n, 0) AS n_license_lines
FROM (SELECT r, doc_id, sha256({whole}) AS digest FROM d) w LEFT JOIN k ON w.digest = k.digest LEFT JOIN g USING (r)
"""
