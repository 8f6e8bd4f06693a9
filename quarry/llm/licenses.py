"""Licence scans by canonical digest: whole texts, and whole lines, against the digests of known licences.

Only DataFrame functions. A text is lower-cased, loses its copyright lines, takes one spelling of words that licences
spell in several ways, and keeps only its letters and digits, in words joined by single spaces. Its SHA-256 then
meets the digests of known texts in a hash join.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import keyed

#: Spellings that count as one, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenc", "licens"), ("organisation", "organization"), ("recognis", "recogniz"), ("authoris", "authoriz"),
    ("favour", "favor"), ("behaviour", "behavior"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("whilst", "while"),
    ("sub-licens", "sublicens"), ("non-infring", "noninfring"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("https", "http"), ("&", " and "),
)
_COPYRIGHT = r"(^|\n)[^\n]*(copyright (\(c\)|©|[0-9])|\(c\) *[0-9]|©)[^\n]*"
#: Every line that matches _COPYRIGHT holds one of these; few texts do.
_SIGNS = ("copyright ", "(c)", "©")
_OTHER = r"[^\p{L}\p{N}]+"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. """
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Known licences and notices, by identifier.
KNOWN = (
    ("MIT", _MIT + _WARRANTY), ("MIT", "MIT License " + _MIT + _WARRANTY), ("MIT", "The MIT License (MIT) " + _MIT + _WARRANTY),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "MIT License"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC), ("0BSD", _PERMIT + ". " + _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)


_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law. """
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN += (("Unlicense", _UNLICENSE + _WARRANTY.replace("AUTHORS OR\nCOPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>"), ("Zlib", _ZLIB), ("Zlib", "zlib License " + _ZLIB), ("BSL-1.0", _BOOST))
#: SHA-256 of the canonical form of long licences: as published, and up to the end of their terms.
DIGESTS = (
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"), ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"), ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"), ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"), ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8a4692e318e41e8d96d4610f021d16f03ff4485322f3d81c00d2621fdda7b2b1"), ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "0248b317bc123a7424b6ff9799b9786ffde75241881994270612a604d03836cc"), ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "335e2e9a39badb7f3faa5b6e393ff8b393f868383be9ddbf866c5821b34f4810"), ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"), ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"), ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"), ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "d0f8b771aff93899189a1c00b418f79ede754095b9039590e567e304c0ef6832"), ("MPL-2.0", "12274540925f246f7614a52b7ebddfbe0463ff1ab194088c554c73552c45582d"), ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
)


def spelled(text: Column) -> Column:
    """Line by line: what it does to a line doesn't depend on the others, so the lines of it are it of the lines."""
    text = F.lower(text)
    signed = reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in _SIGNS))
    text = F.when(signed, F.regexp_replace(text, _COPYRIGHT, "$1")).otherwise(text)
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _OTHER, " "))


def canonical(text: Column) -> Column:
    return letters(spelled(text))


def known(spark: SparkSession, texts=KNOWN, digests=DIGESTS) -> DataFrame:
    """digest, license: one row for each canonical text; the first identifier that has it, texts before digests."""

    def local(rows, name: str, first: int) -> DataFrame:
        """By Arrow, which becomes a local relation: lists of rows would start Python workers on the executors."""
        columns = {"i": pa.array(range(first, first + len(rows)), pa.int32()), "license": pa.array([k for k, _ in rows], pa.string()), name: pa.array([x for _, x in rows], pa.string())}
        return spark.createDataFrame(pa.table(columns))

    named, given = local(texts, "text", 0), local(digests, "digest", len(texts))
    named = named.select("i", "license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return named.unionByName(given).groupBy("digest").agg(F.min_by("license", "i").alias("license"))


def scan(docs: DataFrame, texts=KNOWN, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license, n_license_lines, line_licenses of every document.

    digest is that of the whole canonical text, license what it is known as (null if unknown); line_licenses are the
    identifiers of lines that as a whole are a known text, sorted, comma-joined. Null texts are empty; texts and lines
    without a letter or digit are no licence; rows that share id and text come back once; an empty table gives none.
    """
    docs = keyed(docs, id_col, text_col).select("doc_id", "h", spelled(F.col("text")).alias("text"))
    parts = docs.select("doc_id", "h", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("at", "part"))
    pieces = parts.select("doc_id", "h", (F.col("at") == 0).alias("whole"), letters(F.col("part")).alias("part"))
    pieces = pieces.select("doc_id", "h", "whole", F.sha2("part", 256).alias("digest"), (F.col("part") != "").alias("some"))
    named = F.broadcast(known(docs.sparkSession, texts, digests))  # as many rows as texts and digests
    found = pieces.join(named, (pieces.digest == named.digest) & pieces.some, "left").select("doc_id", "h", "whole", pieces.digest, "license")
    line = ~F.col("whole") & F.col("license").isNotNull()
    return found.groupBy("doc_id", "h").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.floor(F.count_if(line) / F.count_if("whole")).alias("n_license_lines"),  # rows that share id and text have a whole each
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
    ).drop("h")
