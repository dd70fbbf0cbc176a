"""Licence scans with built-in functions only: the canonical form of an entire text is hashed and looked up among the
digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A known-licence table of at most so many rows is broadcast; a larger one is joined by a shuffle with salted hot digests.
BROADCAST_ROWS = 20_000
SALTS = 16

#: Equivalent spellings, applied in this order to lower-case words between single blanks.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("organisation", "organization"), ("organisations", "organizations"), ("utilisation", "utilization"), ("recognised", "recognized"), ("favour", "favor"), ("behaviour", "behavior"), ("fulfil", "fulfill"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("merchantable quality", "merchantability"), ("copyright holders", "copyright holder"), ("copyright owner", "copyright holder"), ("http", "https"))

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: (licence, entire text). Several texts may name one licence.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _ZERO_BSD),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n2. {_BSD_2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n1. {_BSD_1}\n2. {_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n2. {_BSD_2}\n3. {_BSD_3}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n1. {_BSD_1}\n2. {_BSD_2}\n3. {_BSD_3}\n\n{_BSD_END}"),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0-or-later", _GPL3_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Lines that only state a copyright, with a year or without, dropped with their line break; text is in lower case by
#: then. A line of the licence itself may begin "copyright holder" or "copyright notice", or with the list mark "(c)".
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*((copyright|\(c\)|©)[^\n]*(19|20)[0-9][0-9]|copyright[ \t]*(\(c\)|©|by[ \t:])|©)[^\n]*"
RIGHTS_LINE = r"(^|\n)[ \t#*/;-]*all rights reserved[. \t]*"
#: ASCII but letters and digits, no-break and other blanks, general punctuation (dashes, quotes, dots), and the marks
#: of Latin-1 that print in licences.
PUNCTUATION = r"[\x00-/:-`{-\x7f\x{80}-\x{a0}\x{a7}\x{a9}\x{ab}\x{ad}\x{b6}\x{b7}\x{bb}\x{2000}-\x{206f}\x{3000}\x{feff}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: List marks at the start of a line: "1.", "(a)", "*", "-".
BULLET = r"(^|\n)[ \t#*/;-]*(\(?[0-9a-z][.)][ \t])?"


def canonical(text: Column) -> Column:
    """Lower case (A to Z), no copyright lines, no list marks, runs of punctuation, also typographic, and white space as
    one blank, and equivalent spellings made one. Null stays null.

    While spellings are replaced, two blanks part neighbours, so that each word has blanks of its own."""
    x = F.translate(text.cast("string"), UPPER, LOWER)
    x = F.regexp_replace(F.regexp_replace(x, COPYRIGHT_LINE, "\n"), RIGHTS_LINE, "\n")
    x = F.regexp_replace(x, BULLET, "\n")
    x = F.concat(F.lit("  "), F.trim(F.regexp_replace(x, PUNCTUATION, "  ")), F.lit("  "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, license: one row per digest, the alphabetically first licence of several."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, license_digest, license: each document's digest, and the known licence whose canonical text is the same.

    license is null if the text is no known licence. A null text has a null digest and no licence; an empty text has the
    digest of nothing and, unless that is among the known, none either. Repeated rows give repeated results; other
    columns play no part. Documents don't move while `known` (digest unique, license) has at most BROADCAST_ROWS rows;
    beyond that, both sides are dealt by digest and salt, so that a text that many documents share is spread.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    mine = docs.select("doc_id", digest(F.col("text")).alias("license_digest"))
    theirs = known.select(F.col("digest").alias("_digest"), "license")
    if theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return mine.join(F.broadcast(theirs), F.col("license_digest") == F.col("_digest"), "left").drop("_digest")
    mine = mine.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    theirs = theirs.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return mine.join(theirs, (F.col("license_digest") == F.col("_digest")) & (F.col("_salt") == F.col("_of")), "left").drop("_digest", "_salt", "_of")
