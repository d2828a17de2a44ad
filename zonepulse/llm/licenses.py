"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to canonical form: lower case, copyright lines, a title in front
and numbers of clauses dropped, everything but letters and digits turned into single
spaces, equivalent spellings unified. The SHA-256 of the whole canonical text is
joined with the digests of known licences, which are made by the same expression
from their texts.

The usual table of known licences is the caller's own, made by ``digests_of`` from
any table of names and texts (Parquet) and joined by Spark's own choice. Without one
the literal rows of this module count (a fixed, small table, so broadcasting them is
bounded): texts of short licences and digests of long ones.

Edge cases: a null text has a null digest and no licence; an empty one, or one of
punctuation only, has the digest of the empty string and no licence. Several
names for one digest are all listed, sorted. Repeated rows give repeated results.
Texts of any length are taken whole: no pattern recurses or reads a line twice.
Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type

#: Equivalent spellings of canonical words, applied in this order. Fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("noninfringement", "non infringement"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
]
#: What is dropped at the start of a line: a whole line that states a copyright and is
#: no clause of a licence, or the number or letter of a clause.
_COPYRIGHT = r"(?:copyright|©|\(c\)|all rights reserved)(?:[ \t,:]*(?:copyright|©|\(c\)|[0-9]{4})[^\n]*|[ \t.]*)$"
_NUMBER = r"(?:\(?[0-9]{1,2}[.)]|\(?[a-z]\))[ \t]+"
LINE_STARTS = rf"(?md)^(?:[ \t#*/;%-]*{_COPYRIGHT}|[ \t]*{_NUMBER})"
#: Lines before the text that name the licence, its version or its address; the lines go if something follows them.
TITLE_LINES = [
    r"[^a-z0-9\n]*(?:[a-z0-9.+\"'()/,-]+[ \t]+){0,8}(?:un)?licen[sc]e(?:[ \t]+\([^\n)]*\))?(?:[,: \t-]*v(?:ersion)?\.?[ \t]*[0-9.]+[^\n]{0,40})?[^a-z0-9\n]*",
    r"[^a-z0-9\n]*version[ \t]+[0-9][^\n]{0,40}",
    r"[ \t<]*https?://[^ \t\n]+[ \t]*",
]


def _in_one_go(pattern: str) -> str:
    """The pattern with repeated character classes that keep what they took: none of them holds what may follow it."""
    return re.sub(r"(\[(?:\\.|[^\]])*\])([*+])", r"\1\2+", pattern)


#: Java matches a repeated group by recursion, a possessive one by a loop; nothing that one line takes is looked at twice.
FRONT = r"\A(?:(?:[^a-z0-9\n]*+\n)*+(?:" + "|".join(map(_in_one_go, TITLE_LINES)) + r")\n(?=[^a-z0-9]*+[a-z0-9]))++"
#: Runs of anything else, but for the single space that stays.
JUNK = r"[^a-z0-9]{2,}|[^a-z0-9 ]"

#: Texts of licences in common use, public knowledge; fixed values.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
}


#: SHA-256 of the canonical form of long licences, as their publishers distribute them; fixed values.
DIGESTS = {
    "Apache-2.0": "9d8ee9581a1c3049ed07bc02e137c5bd2a477f9973802a9825ec98fe4fdd3aea",
    "Artistic-1.0-Perl": "538e2e59281ba267abc1d1844748259521b4d2f0e90e9cca0ee2b8a86ffbe6fa",
    "CC0-1.0": "2106cd4f7c9f6d4a9e5f54c911e4ff372736db5467794e4b89bcea996afde21c",
    "GFDL-1.2": "dd05ed2bb4a74613332aabd60fa38270315213a92888dd5ec6a48cb892fa896b",
    "GFDL-1.3": "d2b08ce49a6fec1ff312395a7e1a2104acfbe3651fc0e1163ad2c8c419b1e4d2",
    "GPL-1.0": "b3908754c41348bca45f9273c4c7f173a9856f8d11d8a8220ffcff83ba6d296d",
    "GPL-2.0": "f3e20d0d5562de492fc0e0aa08a81142ae6b4f47ed27f48becf1897037258d68",
    "GPL-3.0": "fed4241aa4a095db62c00d728f8cb62a59bba59ca924dcaade64b714daf9c536",
    "LGPL-2.0": "673fabf12e0a0a178a38dcf8e5b3c217e7794793c74d71b2a3e9734845c15fca",
    "LGPL-2.1": "2004a1e3bc8d4a290087156649dd6b8864ab90a121d96d75ad8a9f13c9fb9dbe",
    "LGPL-3.0": "599e236ddcb69302837061770c9ad5f7b2e9908bdde58f1d38401c54304f7934",
    "MPL-1.1": "9be52266a36d6b9e05c4b01139a5ef8551dfb6da25dd9a0d9b70c9cd1062915e",
    "MPL-2.0": "7c1798640b96698d614cf4457ebd8f6ae71b9897919386e1e19a9c142f7923ec",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), LINE_STARTS, " "), FRONT, "")
    out = F.trim(F.regexp_replace(out, JUNK, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def digests_of(texts: DataFrame, license_col: str = "license", text_col: str = "text") -> DataFrame:
    """(digest, license) of a table of licence texts, for ``scan``; null texts and names are left out."""
    rows = texts.select(digest(F.col(text_col).cast("string")).alias("digest"), F.col(license_col).cast("string").alias("license"))
    return rows.where("digest is not null and license is not null")


def known_licenses(spark: SparkSession) -> DataFrame:
    """(digest, license) of the licences named here."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(KNOWN.items())])
    long = F.array(*[F.struct(F.lit(v).alias("digest"), F.lit(k).alias("license")) for k, v in sorted(DIGESTS.items())])
    one = spark.range(1)
    return digests_of(one.select(F.inline(rows))).unionByName(one.select(F.inline(long)))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest, license (all names of the digest, sorted; null if unknown)."""
    own = known is None
    known = known_licenses(docs.sparkSession) if own else known
    names = known.groupBy("digest").agg(F.concat_ws(" or ", F.array_sort(F.collect_set("license"))).alias("license"))
    rows = docs.select(F.col(id_col).cast(id_type(docs, id_col)).alias("id"), digest(F.col(text_col).cast("string")).alias("digest"))
    return rows.join(F.broadcast(names) if own else names, "digest", "left").select("id", "digest", "license")
