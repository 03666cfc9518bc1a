"""Licence scans by canonical digests (native).

A text is brought into canonical form: lower case, copyright lines out, equivalent spellings made equal, everything but
letters and digits a single space. Its SHA-256 is looked up among the digests of known licences. Whole texts, paragraphs
and lines are looked up alike, so a document that is a licence, and one that carries a notice, or a licence's text as a
paragraph of its own, are both found. A text that merely mentions a licence is not, nor is one in which a licence of several
paragraphs stands among others.

Scale: a text without a word that every known licence has is passed by with one pattern. The known digests are fewer than a
thousand rows, fixed in this module, so their broadcast is bounded; nothing else moves but one row per unit found.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every canonical licence has one of these; the canonical form never makes one.
HINT = "(?i)licen[cs]|permission|permitted|warrant|public domain|redistribut|(released|distributed|available)[^a-z0-9]+under"

#: Spellings that count as equal, each with the one that stands for it.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("customisation", "customization"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantability", "merchantability"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Steps of the canonical form, in order, as (pattern, replacement); both Java and RE2 read them.
STEPS = (
    ("(^|\\n)[^a-z0-9\\n]*(copyright( ?\\([c]\\)| ?©)? ?[0-9<\\[{(y][^\\n]*|\\([c]\\) [^\\n]*|©[^\\n]*|all rights reserved[^a-z0-9\\n]*)", "\n"),
    ("https?://", "http "),
    ("[^a-z0-9]+", "  "),  # two, so that neighbours that are both replaced share no blank
    *[(f"(^| ){a.strip().replace(' ', '  ')}($| |s |d )", f"$1{b.strip().replace(' ', '  ')}$2") for a, b in EQUIVALENT if a != b],
    ("  +", " "),
    ("^ +| +$", ""),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Public licence texts.
TEXTS = {
    "MIT": (_MIT, "MIT License\n" + _MIT, "The MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT),
    "MIT-0": (_MIT.replace("\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "").replace(", subject to the following conditions:", "."),),
    "ISC": (_ISC, "ISC License\n" + _ISC, _ISC.replace("and/or", "and")),
    "0BSD": (_ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),),
    "BSD-2-Clause": ("\n".join((_BSD_HEAD, _BSD_TAIL)), "BSD 2-Clause License\n" + "\n".join((_BSD_HEAD, _BSD_TAIL))),
    "BSD-3-Clause": ("\n".join((_BSD_HEAD, _BSD_THIRD, _BSD_TAIL)), "BSD 3-Clause License\n" + "\n".join((_BSD_HEAD, _BSD_THIRD, _BSD_TAIL))),
    "Unlicense": (_UNLICENSE,),
    "Apache-2.0": (_APACHE_NOTICE,),
}
#: Names under which notices cite a licence.
CITED = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "ISC": ("ISC License", "ISC"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}") for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "3.0", "4.0")},
}
#: The sentences of notices.
NOTICES = ("Released under {}.", "Released under the {}.", "Licensed under {}.", "Licensed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "Distributed under the {}.", "Available under the {}.", "License: {}", "SPDX-License-Identifier: {}")
#: Canonical digests of long public licences, of which the texts are not kept here.
DIGESTS = {
    "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a": "GPL-1.0",
    "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61": "MPL-1.1",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
}


def canonical_text(text: str) -> str:
    """The canonical form of a text, as canonical() gives it."""
    out = text.lower()
    for pattern, put in STEPS:
        out = re.sub(pattern, put.replace("$", "\\"), out)
    return out


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put)
    return out


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known() -> dict[str, str]:
    """Licence by canonical digest."""
    found = dict(DIGESTS)
    for licence, texts in TEXTS.items():
        for text in texts:
            found.setdefault(digest_of(text), licence)
    for licence, names in CITED.items():
        for name in names:
            for notice in NOTICES:
                found.setdefault(digest_of(notice.format(name)), licence)
    return found


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, licence (of the whole text, or null), notices (licences of its paragraphs and lines, sorted, joined by commas) and n_units for every row of docs (doc_id, text).

    n_units counts paragraphs and lines found. Null and empty texts have no licence. Rows are scanned one by one, so repeated
    rows and null ids need no rule. An empty table gives an empty result. Other columns are not looked at.
    """
    listed = F.from_json(F.lit(json.dumps(known(), sort_keys=True)), "map<string,string>")
    table = docs.sparkSession.range(1).select(F.explode(listed).alias("digest", "licence"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.monotonically_increasing_id())
    has = F.col("text").rlike(HINT)
    rest = base.where(~has).select("doc_id", F.lit(None).cast("string").alias("licence"), F.lit("").alias("notices"), F.lit(0).cast("long").alias("n_units"))

    def units(kind, parts):
        return F.transform(F.filter(parts, lambda x: x.rlike(HINT)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))

    every = F.concat(F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("unit"))), units("paragraph", F.split("text", "\n[ \t\r]*\n")), units("line", F.split("text", "\n")))
    looked = base.where(has).select("_id", "doc_id", F.explode(every).alias("u")).select("_id", "doc_id", "u.kind", F.sha2(canonical(F.col("u.unit")), 256).alias("digest"))
    found = looked.join(F.broadcast(table), "digest", "left").groupBy("_id", "doc_id").agg(
        F.max(F.when(F.col("kind") == "text", F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") != "text", F.col("licence")))), ",").alias("notices"),
        F.count(F.when(F.col("kind") != "text", F.col("licence"))).alias("n_units"),
    )
    return rest.unionByName(found.drop("_id"))
