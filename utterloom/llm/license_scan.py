"""License scans by canonical digest lookup.

A text is normalised as a whole (case, copyright lines, equivalent spellings,
punctuation, white space), its SHA-256 is taken, and the digests are hash-joined
with those of known licence texts and notices, normalised in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import lower_ascii

#: Equivalent spellings, whole words after lower-casing and removal of punctuation.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("unlicence", "unlicense"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("authorised", "authorized"), ("authorisation", "authorization"), ("favour", "favor"),
    ("behaviour", "behavior"), ("noninfringement", "non infringement"), ("merchantibility", "merchantability"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https", "http"),
]

#: A copyright line: it begins with a copyright sign or word and a sign, year, name or holder; or reserves all rights.
COPYRIGHT_LINE = r"(^|\n)[^0-9a-z\n]*(copyright[^0-9a-z\n]*(\(c\)|©|[0-9][0-9][0-9][0-9]|<|\[)|\(c\)|©|all rights reserved)[^\n]*"

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_2 = BSD_TWO + "\n" + BSD_DISCLAIMER
BSD_3 = BSD_TWO + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

""" + BSD_DISCLAIMER
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + ISC_BODY.split("\n\n")[1]
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

#: Known texts and notices (licence id, text). Fixed values of public licences; more, such as the long texts of Apache-2.0, GPL or MPL, come as a parameter.
KNOWN = [
    ("MIT", MIT_BODY), ("MIT", "MIT License\n\n" + MIT_BODY), ("MIT", "The MIT License (MIT)\n\n" + MIT_BODY), ("ISC", ISC_BODY), ("ISC", "ISC License\n\n" + ISC_BODY),
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2), ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("0BSD", ZERO_BSD), ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD), ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Unlicense", UNLICENSE), ("BSL-1.0", BOOST),
    ("Apache-2.0", APACHE_NOTICE), ("GPL-3.0-or-later", GPL_NOTICE), ("GPL-2.0-or-later", GPL_NOTICE.replace("version 3", "version 2")),
    ("LGPL-3.0-or-later", GPL_NOTICE.replace("General Public", "Lesser General Public")), ("AGPL-3.0-or-later", GPL_NOTICE.replace("General Public", "Affero General Public")), ("MPL-2.0", MPL_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
]
#: The bound on what is broadcast.
MAX_KNOWN = 100_000


def canonical(c):
    """The normal form of a text column: lower case, no copyright lines, one spelling, words parted by single spaces."""
    x = F.regexp_replace(lower_ascii(F.coalesce(c, F.lit(""))), "\r\n?", "\n")
    x = F.regexp_replace(x, COPYRIGHT_LINE, "$1")
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[\x00-/:-@\[-`{-~\x7f©®™“”‘’–—«»…]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """license_id, digest; when two licences have one normal form the smallest id stands for it."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts")
    texts = spark.createDataFrame(known, "license_id string, text string")
    return texts.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, n_canonical (characters), license_id (null: no known licence).

    The whole text is looked up; null and empty texts have the empty normal form, which is
    no licence. Rows that repeat an id get their own row. Other columns are ignored. The
    known texts are a driver-side list of MAX_KNOWN at most, so the broadcast side is bounded.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("c"))
    rows = rows.select("doc_id", F.sha2("c", 256).alias("canonical_sha256"), F.length("c").cast("long").alias("n_canonical"))
    found = known_digests(spark, known)
    out = rows.join(F.broadcast(found), rows["canonical_sha256"] == found["digest"], "left")
    return out.select("doc_id", "canonical_sha256", "n_canonical", F.when(F.col("n_canonical") > 0, F.col("license_id")).alias("license_id"))
