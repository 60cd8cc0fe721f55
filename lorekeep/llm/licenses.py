"""License scans: canonical digests of whole texts joined with those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, quoted

#: Words, and words in a row, that the matching guidelines for licence texts hold equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisation": "capitalization",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "modelling": "modeling",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "noncommercial": "non commercial",
    "copyright owner": "copyright holder",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "https": "http",
}
#: A copyright notice at the start of a line, up to the line's end or the licence's own first words: the word or (c) with
#: a sign or a year after it, a sign, or the reserved rights.
YEAR = r"[\[<({]?(19[0-9][0-9]|20[0-9][0-9]|yyyy|year)"
COPYRIGHT = (
    r"(^|\n)[ \t*#/;>-]*(copyright[ \t:]*(\(c\)|©|" + YEAR + r")|\(c\)[ \t:]*(copyright|" + YEAR + r")|©|all rights reserved)[^\n]*?"
    r"(?=permission is hereby|permission to use|redistribution and use|licensed under|this software is|\n|$)"
)
#: The rule of the DuckDB twin, whose SQL stays as it was; it also drops lines of a text that only begin with the word.
TWIN_COPYRIGHT = r"(^|\n)[ \t*#/;>-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Widely used short licence texts and notices (fixed values).
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


#: SHA-256 of the canonical forms of longer texts (fixed values; ``canonical`` makes them).
DIGESTS = {
    "Apache-2.0": "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def canonical(text: Column) -> Column:
    """Lower case, no copyright notices, words alone, one spelling each."""
    out = F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), COPYRIGHT, "\n")
    out = F.regexp_replace(out, NOT_WORD, "  ")  # every word between two spaces of its own
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licenses(spark) -> DataFrame:
    return spark.createDataFrame(sorted(KNOWN.items()), "license_id string, license_text string")


def digests_of(known: DataFrame) -> DataFrame:
    """(license_id, digest) of whole licence texts (license_id, license_text). Texts without words have none."""
    digests = known.select("license_id", canonical(F.col("license_text")).alias("_c")).where("_c <> ''")
    return digests.select("license_id", F.sha2("_c", 256).alias("digest"))


def texts_in(spark, folder: str) -> DataFrame:
    """Licence texts, one file each, named by their ids, for ``known``."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.txt)?$", 1)
    found = spark.read.format("binaryFile").load(folder).select(name.alias("license_id"), F.decode("content", "UTF-8").alias("license_text"))
    return found


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """Add canonical_sha256, canonical_chars and license_id, the known licence that the entire text is.

    ``known`` has license_id and license_text; without it, KNOWN and DIGESTS are. Its digests go to all tasks when there
    are at most ``max_broadcast`` of them; else the join shuffles. Texts known under several ids give the least one.
    Null and empty texts, and texts of copyright lines alone, are no licence. Columns of the input with a result's
    name are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("canonical_sha256", "canonical_chars", "license_id")
    body, digest = fresh(docs, "_body", "_digest")
    digests = digests_of(known if known is not None else known_licenses(spark))
    if known is None and DIGESTS:
        digests = digests.union(spark.createDataFrame(sorted(DIGESTS.items()), "license_id string, digest string"))
    digests = digests.groupBy(F.col("digest").alias(digest)).agg(F.min("license_id").alias("license_id"))
    if digests.limit(max_broadcast + 1).count() <= max_broadcast:
        digests = F.broadcast(digests)
    found = docs.withColumn(body, canonical(quoted(text_col)))
    found = found.withColumns({"canonical_sha256": F.sha2(body, 256), "canonical_chars": F.char_length(body).cast("long")})
    joined = found.join(digests, found["canonical_sha256"] == digests[digest], "left")
    return joined.select(*[quoted(c) for c in docs.columns], "canonical_sha256", "canonical_chars", "license_id")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "canonical_sha256", "canonical_chars", "license_id")


def sql() -> str:
    """The same for DuckDB but for TWIN_COPYRIGHT."""
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        x = f"regexp_replace({x}, {text(TWIN_COPYRIGHT)}, chr(10), 'g')"
        x = f"' ' || regexp_replace({x}, {text(NOT_WORD)}, '  ', 'g') || ' '"
        for old, new in SPELLINGS.items():
            x = f"replace({x}, {text(f' {old.replace(" ", "  ")} ')}, {text(f' {new.replace(" ", "  ")} ')})"
        return f"trim(replace({x}, '  ', ' '))"

    rows = ", ".join(f"({text(k)}, {text(v)})" for k, v in sorted(KNOWN.items()))
    more = "".join(f" UNION ALL SELECT {text(k)}, {text(v)}" for k, v in sorted(DIGESTS.items()))
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(c) AS digest
    FROM (SELECT license_id, {canon("license_text")} AS c FROM (VALUES {rows}) v(license_id, license_text)) WHERE c <> ''{more})
  GROUP BY 1
), bodies AS (SELECT doc_id, {canon("text")} AS c FROM documents)
SELECT doc_id, sha256(c) AS canonical_sha256, length(c) AS canonical_chars, license_id
FROM bodies LEFT JOIN known ON sha256(c) = digest
"""
