"""License scans by canonical digest lookup.

A text's canonical form drops copyright lines, case, punctuation and runs of white space, and writes equivalent
spellings one way. The digests of the catalogue's texts are hash-joined (they are few, so broadcast) with the digest of
each whole document, of each of its paragraphs, of each of its lines, and of each part that could be a known text: where
its first words stand, as many characters as it has. So a licence inside a source file is found, whatever marks its
comment lines. Of long licences the catalogue holds first words, length and digest only, with what follows the terms and without.

Defined cases: a null text counts as empty; an empty canonical form matches nothing; a very long text is one row, and its
parts are looked at only where first words of a known text stand; repeated rows get the same answer; null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

# Spellings that count as equal (left: as found in canonical text, right: as compared).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "copyright holder": "copyright owner",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "https": "http",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "per cent": "percent",
    "sub license": "sublicense",
    "whilst": "while",
}

# Short notices and whole licences by SPDX name.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
}
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS
TEXTS = {
    "MIT": ["MIT License\n\nCopyright (c) 2020 Somebody\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, _MIT],
    "ISC": ["ISC License\n\nCopyright (c) 2020 Somebody\n\n" + _ISC, _ISC],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS],
    "BSD-2-Clause": [_BSD_2 + "\n\n" + _BSD_AS_IS],
    "BSD-3-Clause": [_BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_AS_IS],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."],
}
# Of long licences by SPDX name, as distributed: first words, characters and digest of the canonical form.
LONG_TEXTS = [
    ("Apache-2.0", "apache license version 2 0 january 2004 http www", 9921, "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "apache license version 2 0 january 2004 http www", 8866, "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "the artistic license preamble the intent of this", 5823, "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal cr", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free documentation license version 1 2 novem", 19576, "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "gnu free documentation license version 1 3 3 nov", 22005, "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "gnu general public license version 1 february 19", 11762, "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "gnu general public license version 1 february 19", 9412, "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0", "gnu general public license version 2 june 1991 5", 17113, "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "gnu general public license version 2 june 1991 5", 14479, "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0", "gnu general public license version 3 29 june 200", 33395, "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("GPL-3.0", "gnu general public license version 3 29 june 200", 30957, "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("LGPL-2.0", "gnu library general public license version 2 jun", 24126, "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0", "gnu library general public license version 2 jun", 22273, "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 fe", 25213, "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 fe", 23361, "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 j", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions", 22447, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
FIRST_CHARS = 48
#: Characters of a canonical text in which parts are looked for at once; what a part that starts there may need is read with them.
BLOCK = 1 << 14
#: Every catalogue text holds one of these in its canonical form, so a unit without them can't match.
ANCHORS = "[lL][iI][cC][eE][nN][cCsS][eE]|[pP][eE][rR][mM][iI][sS][sS][iI][oO][nN]|[rR][eE][dD][iI][sS][tT][rR][iI][bB]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "0-9a-z\\x{80}-\\x{10ffff}"
COPYRIGHT_LINE = f"(^|\\n)[^\\n{_WORD}]*(copyright[ \\t]*(\\(c\\)|©|[0-9]{{4}}|by )|\\(c\\)[ \\t]*[0-9]|©|all rights reserved)[^\\n]*"
BREAKS = f"[^{_WORD}]+"


def canonical(text: Column) -> Column:
    low = F.translate(text, _UPPER, _LOWER)
    low = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    low = F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), BREAKS, " "))
    for found, meant in SPELLINGS.items():
        low = F.replace(low, F.lit(found), F.lit(meant))
    return low


def catalogue(spark: SparkSession) -> DataFrame:
    """license_id, digest, first (FIRST_CHARS characters or fewer) and length of all known texts and notices; whole: more
    than a notice."""
    rows = [(k, t, whole) for whole, known in ((False, NOTICES), (True, TEXTS)) for k, texts in known.items() for t in texts]
    made = spark.createDataFrame(rows, "license_id string, text string, whole boolean").withColumn("c", canonical(F.col("text")))
    made = made.select("license_id", F.sha2("c", 256).alias("digest"), F.substring("c", 1, FIRST_CHARS).alias("first"), F.length("c").alias("length"), "whole")
    long = spark.createDataFrame([(k, d, f, n, True) for k, f, n, d in LONG_TEXTS], "license_id string, digest string, first string, length int, whole boolean")
    return made.unionByName(long).distinct()


def _parts(whole: Column, known: list) -> Column:
    """Digests of the parts of a canonical text that start like a known text and are as long."""
    padded = F.concat(F.lit(" "), whole, F.lit(" "))
    table = F.array(*[F.struct(F.lit(r.first).alias("first"), F.lit(r.length).alias("length")) for r in known])
    beyond = max(r.length for r in known) + 2
    # block by block, as a place in a long text is only found by counting its characters from the start
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(padded) - 1) / BLOCK).cast("int")), lambda n: padded.substr(n * BLOCK + 1, F.lit(BLOCK + beyond)))

    def inside(block: Column, k: Column) -> Column:
        mark = F.concat(F.lit(" "), k["first"])
        gaps = F.split(block, F.concat(F.lit("\\Q"), mark, F.lit("\\E")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def passed(seen: Column, gap: Column) -> Column:
            start = seen["at"] + F.length(gap)
            return F.struct((start + F.length(mark)).alias("at"), F.array_append(seen["starts"], start).alias("starts"))

        starts = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), none, passed)["starts"]
        ended = F.filter(starts, lambda at: (at < BLOCK) & (block.substr(at + 2 + k["length"], F.lit(1)) == " "))
        return F.transform(ended, lambda at: F.sha2(block.substr(at + 2, k["length"]), 256))

    def of(k: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda block: inside(block, k)))

    return F.flatten(F.transform(F.filter(table, lambda k: padded.contains(F.concat(F.lit(" "), k["first"]))), of))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, canonical_sha256, license_id (the whole text is that licence), embedded (licences whose text is
    a part of it, distinct and sorted), n_notices (paragraphs and lines that are a known text), notices (their licences)."""
    found = catalogue(docs.sparkSession)
    known = found.collect()  # as many rows as the catalogue has texts
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.concat(F.split(text, "\n"), F.filter(F.split(text, "\n[ \t]*\n"), lambda p: p.contains("\n")))
    units = F.transform(F.filter(units, lambda u: u.rlike(ANCHORS)), lambda u: F.sha2(canonical(u), 256))
    none = F.array().cast("array<string>")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), canonical(text).alias("whole"), text.rlike(ANCHORS).alias("may"), F.when(text.rlike(ANCHORS), units).otherwise(none).alias("units"))
    parts = F.when(F.col("may"), _parts(F.col("whole"), [r for r in known if r.whole])).otherwise(none)
    rows = materialise(rows.select("id", "key", F.sha2("whole", 256).alias("canonical_sha256"), "units", parts.alias("parts")), "licenses")

    names = F.broadcast(found.groupBy("digest").agg(F.min("license_id").alias("license_id")))
    tagged = lambda kind: F.transform(kind, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("digest")))
    each = rows.filter(F.size("units") + F.size("parts") > 0).dropDuplicates(["key"]).select("key", F.explode(F.concat(tagged("units"), tagged("parts"))).alias("u")).select("key", "u.*").join(names, "digest")
    of = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("license_id")))), ",")
    told = each.groupBy("key").agg(F.count(F.when(F.col("kind") == "units", 1)).alias("n_notices"), of("units").alias("notices"), of("parts").alias("embedded"))
    out = rows.join(names, rows["canonical_sha256"] == names["digest"], "left").join(told, "key", "left")
    return out.select(F.col("id").alias(id_col), "canonical_sha256", "license_id", F.coalesce("embedded", F.lit("")).alias("embedded"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op1_license_scan(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def sql(x: str) -> str:
        x = f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        x = f"trim(regexp_replace(replace({x}, '&', ' and '), {quote(BREAKS)}, ' ', 'g'))"
        for found, meant in SPELLINGS.items():
            x = f"replace({x}, '{found}', '{meant}')"
        return x

    rows = [(k, t, whole) for whole, known in ((False, NOTICES), (True, TEXTS)) for k, texts in known.items() for t in texts]
    short = ", ".join(f"({quote(k)}, {quote(t)}, {whole})" for k, t, whole in rows)
    long = ", ".join(f"({quote(k)}, {quote(d)}, {quote(f)}, {n}, true)" for k, f, n, d in LONG_TEXTS)
    return f"""
WITH made AS (SELECT license_id, {sql('t')} AS c, whole FROM (VALUES {short}) v(license_id, t, whole)),
known AS (SELECT DISTINCT license_id, sha256(c) AS digest, substr(c, 1, {FIRST_CHARS}) AS first, length(c) AS n, whole FROM made UNION SELECT * FROM (VALUES {long}) v),
names AS (SELECT digest, min(license_id) AS license_id FROM known GROUP BY digest),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text, {sql('text')} AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
units AS (SELECT rid, unnest(string_split(text, chr(10))) AS u FROM docs
  UNION ALL SELECT rid, u FROM (SELECT rid, unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS u FROM docs) WHERE contains(u, chr(10))),
found AS (SELECT rid, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT rid, sha256({sql('u')}) AS digest FROM units) JOIN names USING (digest) GROUP BY rid),
padded AS (SELECT rid, ' ' || c || ' ' AS p FROM docs),
spots AS (SELECT rid, p, n, unnest(range(1, length(p) - length(first))) AS spot, first FROM padded JOIN (SELECT DISTINCT first, n FROM known WHERE whole) ON contains(p, ' ' || first)),
parts AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS embedded FROM (SELECT rid, sha256(substr(p, spot + 1, n)) AS digest FROM spots
  WHERE substr(p, spot, length(first) + 1) = ' ' || first AND substr(p, spot + 1 + n, 1) = ' ') JOIN names USING (digest) GROUP BY rid)
SELECT doc_id, sha256(c) AS canonical_sha256, license_id, coalesce(embedded, '') AS embedded, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM docs LEFT JOIN names ON sha256(c) = digest LEFT JOIN found USING (rid) LEFT JOIN parts USING (rid)
"""


OP1_SQL = _oracle()
