"""Licence scan by canonical digest: texts that normalise alike get one digest, which is looked up among known licences.

Normalising lower-cases, drops copyright lines, makes equivalent spellings one (licence/license, URLs without scheme and
slash), and leaves letters and digits only, with one space between words. Whole texts and their single lines are digested:
a line holds a whole short notice. Copyright lines are told by their first word, so a licence is known in
the wrappings in which different lines begin with it: all widths of short texts, the published and one line a paragraph of long ones. Null or empty texts match nothing. Repeated rows each get a row; an empty table gives an
empty result. Very long texts are digested whole. Of several licences with one digest the first by name counts. Columns besides doc_id and text are ignored."""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stored
from .license_texts import TEXTS

#: Known digests that are held beside each row at most.
LISTED = 5000

# Public licence texts and notices, as published. Copyright lines are left out by normalising.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_LISTED = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Released under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
)
#: Equivalent spellings, after lower-casing and before punctuation goes: (pattern, one spelling).
SPELLINGS = (("licen[cs]", "licens"), ("https?://(www\\.)?", ""), ("non-?infringement", "noninfringement"), ("\\bv(er(sion)?)?[. ]*(?=[0-9])", "version "))
#: Lines that give a holder or a year; in their place stands nothing.
COPYRIGHT = "(?im)^[ \\t\\W]*(copyright\\b|\\(c\\)|©)[^\\n]*$|^[ \\t\\W]*all rights reserved\\W*$"


_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_MIT_0 = _MIT.replace(""", subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", ".")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.

You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "MIT-0": ("MIT No Attribution",), "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "Zlib": ("zlib License", "The zlib License"), "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense",),
}
#: Names of licences in notices of one line.
NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"), "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"), "Artistic-2.0": ("Artistic License 2.0",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    **{f"CC-{k}-4.0": (f"CC {k} 4.0", f"CC-{k}-4.0", f"Creative Commons {n} 4.0 International License", f"a Creative Commons {n} 4.0 International License") for k, n in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
_OPENINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This software is released under")
#: Names in SPDX tags that say more than a licence's own.
_TAGS = {f"{n}-{end}": n for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later")} | {f"{n}+": n for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")}


def _wrapped(text: str) -> list:
    """The text as it is and, of its wrappings, one for each outcome of dropping copyright lines."""
    flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
    widths = range(50, 133) if len(text) < 4000 else ()
    ways = [text, flat, *("\n\n".join(textwrap.fill(p, w) for p in flat.split("\n\n")) for w in widths)]
    return list({" ".join(re.findall(r"\w+", re.sub(COPYRIGHT, "", w))): w for w in reversed(ways)}.values())


def _known() -> tuple:
    """Licence and text of all that is known."""
    texts = [*TEXTS, ("MIT", _MIT), ("MIT-0", _MIT_0), ("ISC", _ISC), ("0BSD", _ZERO_BSD), ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("Apache-2.0", _APACHE_NOTICE), ("MPL-2.0", _MPL_HEADER)]
    texts += [(n, t.replace("* Redistributions of", "1. Redistributions of").replace("* Redistributions in", "2. Redistributions in").replace("* Neither", "3. Neither")) for n, t in TEXTS if n.startswith("BSD")]
    texts += [(n, t[: t.index(end) + len(end)]) for n, t in TEXTS for end in ("END OF TERMS AND CONDITIONS",) if end in t]  # without what follows the terms
    for n, kind, version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")):
        texts.append((n, _GNU_HEADER.format(kind=kind, version=version)))
    out = list(_LISTED)
    for n, t in texts:
        for w in _wrapped(t):
            out += [(n, w), *((n, f"{title}\n\n{w}") for title in _TITLES.get(n, ()) if not w.lower().startswith(title.lower()))]
    for n, names in NAMES.items():
        out += [(n, f"{o} {the}{x}") for o in _OPENINGS for x in names for the in ("the ", "")]
    out += [(n, f"SPDX-License-Identifier: {t}") for t, n in [*((n, n) for n in sorted({n for n, _ in texts} | set(NAMES))), *_TAGS.items()]]
    return tuple(dict.fromkeys(out))


#: (licence, text). Fixed values.
KNOWN = _known()


def canonical(text: Column) -> Column:
    """The normal form of a text."""
    t = F.lower(F.regexp_replace(text, COPYRIGHT, ""))
    for pattern, one in SPELLINGS:
        t = F.regexp_replace(t, pattern, one)
    return F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """digest, licence: the fixed list of this module, digested by the same expression."""
    rows = spark.createDataFrame(list(KNOWN), "licence string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "licence").distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, digest (of the whole text; null for null), licence (of the whole text, or null),
    line_licences (sorted distinct licences of which a line is the whole notice; empty if none).

    Whole texts are joined on their digests. Lines are looked up beside the text in a map of the known digests if these are at most
    LISTED, as this module's are; else the digests of lines are dealt out and joined, too. known: digest, licence."""
    spark = docs.sparkSession
    known = (known_digests(spark) if known is None else known).groupBy("digest").agg(F.min("licence").alias("licence"))
    rows = known.limit(LISTED + 1).collect()
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != "")
    digests = F.transform(lines, lambda s: F.sha2(canonical(s), 256))
    digest = F.sha2(canonical(F.col("text")), 256).alias("digest")
    if len(rows) <= LISTED:
        table = {r["digest"]: r["licence"] for r in rows}
        lookup = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]) if table else F.expr("cast(map() AS map<string, string>)")
        hits = F.transform(F.filter(digests, lambda d: d.isin(list(table))), lambda d: F.try_element_at(lookup, d))
        out = docs.select("doc_id", digest, F.array_sort(F.array_distinct(hits)).alias("line_licences"))
        return out.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "licence", "line_licences")
    own = stored(docs.select("doc_id", digest, F.array_distinct(digests).alias("lines")).withColumn("row", F.monotonically_increasing_id()), "digests")
    found = own.select("row", F.explode("lines").alias("digest")).join(known, "digest").groupBy("row").agg(F.array_sort(F.collect_set("licence")).alias("line_licences"))
    out = own.drop("lines").join(known, "digest", "left").join(found, "row", "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))
