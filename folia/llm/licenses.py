"""Licence scans by canonical digest lookup (native).

A text is made canonical: lower case, copyright lines out, equivalent spellings made one,
punctuation and spaces dropped to single spaces. Its SHA-256 is looked up among the digests of
known licence texts by a hash join with the registry, whose size is fixed by this file. Each
line is looked up too, for the statements that documents carry as a line of their own.

Defined results: a null or empty text has the digest of the empty string and no licence;
repeated rows are looked up one by one; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings (fixed values): the first is written as the second.
SPELLINGS = [("licence", "license"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
             ("authorised", "authorized"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfilment", "fulfillment"),
             ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("organisation", "organization"),
             ("per cent", "percent"), ("redistributions", "redistribution"), ("https", "http")]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|©|\(c\))(?:[^\n]*)$"
#: Known licence texts and statements (fixed values).
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program. If not, see https://www.gnu.org/licenses/.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-statement": "Released under the MIT License.",
}
#: Lines of a real notice: a sign, "copyright" unless it goes on as prose, "(c)" before a year or a name, "all rights reserved".
NOTICE_LINE = (r"(?m)^[^\p{L}\p{N}\n]*(?:©|(?i:copyright)(?![\p{L}\p{N}])(?!\s+(?i:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or|in|is|of|to)(?![\p{L}\p{N}]))"
               r"|\([cC]\)\s*(?:\p{N}{4}|\p{Lu}\p{Ll}+ \p{Lu})|(?i:all rights reserved)[^\p{L}\p{N}\n]*$)[^\n]*$")
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Published forms beside ``KNOWN``, and the titles that files of a licence begin with.
PUBLISHED = {"BSD-2-Clause": _BSD.format(""), "BSD-3-Clause": _BSD.format("""3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """)}
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
          "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"]}

#: Digests of the canonical forms of whole published licence texts (fixed values).
DIGESTS = {
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329": "GPL-3.0",
    "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015": "LGPL-2.0",
    "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}


def canonical(text: Column, published: bool = False) -> Column:
    out = F.lower(F.regexp_replace(text, NOTICE_LINE, "")) if published else F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    # Each word has its own spaces, so that neighbours don't share one.
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(_spaced(a)), F.lit(_spaced(b)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical_text(text: str) -> str:
    """The same for one text on the driver, for the registry."""
    out = "\n".join(x for x in text.lower().split("\n") if not re.match(r"[^\w\n]*(?:copyright|©|\(c\))", x))
    out = _spaced(re.sub(r"[^0-9a-z]+", " ", out).strip())
    for a, b in SPELLINGS:
        out = out.replace(_spaced(a), _spaced(b))
    return out.replace("  ", " ").strip()


def registry(published: bool = False) -> dict[str, str]:
    """Digest -> licence."""
    texts = [(name, t) for name, t in KNOWN.items()]
    if published:
        texts += PUBLISHED.items()
        texts += [(name, f"{title}\n{dict(texts)[name]}") for name, titles in TITLES.items() for title in titles]
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, t in texts} | (DIGESTS if published else {})


def licenses(docs: DataFrame, published: bool = False) -> DataFrame:
    """doc_id, digest, license_id (of the whole text), n_license_lines and their licences in order.

    With ``published``, licences in the form of their files are known too: with titles, any wrapping, lines of any length."""
    known = registry(published)
    rows = docs.sparkSession.createDataFrame(sorted(known.items()), "known string, license_id string")
    names = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda x: F.try_element_at(names, F.sha2(canonical(x, published), 256))
    longest = max(map(len, KNOWN.values()))
    line = name if published else lambda x: F.when(F.length(x) <= longest, name(x))
    lines = F.filter(F.transform(F.split(text, "\n", -1), line), lambda x: x.isNotNull())
    found = docs.select("doc_id", F.sha2(canonical(text, published), 256).alias("digest"), lines.alias("lines"))
    return (found.join(F.broadcast(rows), F.col("digest") == F.col("known"), "left")
            .select("doc_id", "digest", "license_id", F.size("lines").cast("long").alias("n_license_lines"), F.array_join("lines", ",").alias("license_lines")))


def query(docs: DataFrame) -> DataFrame:
    return licenses(docs)


def query_published(docs: DataFrame) -> DataFrame:
    return licenses(docs, published=True)


def _canonical_sql(x: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({x}), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|©|\\(c\\))(?:[^\\n]*)$', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    out = f"(' ' || replace({out}, ' ', '  ') || ' ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{_spaced(a)}', '{_spaced(b)}')"
    return f"trim(replace({out}, '  ', ' '))"


ORACLE = f"""
WITH known(known, license_id) AS (VALUES {', '.join(f"('{d}', '{n}')" for d, n in sorted(registry().items()))}),
d AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
l AS (SELECT doc_id, i, k.license_id FROM u JOIN known k ON k.known = sha256({_canonical_sql('line')}) WHERE length(line) <= {max(map(len, KNOWN.values()))}),
n AS (SELECT doc_id, count(*)::bigint AS n, string_agg(license_id, ',' ORDER BY i) AS names FROM l GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.n, 0)::bigint AS n_license_lines, coalesce(n.names, '') AS license_lines
FROM d LEFT JOIN known k ON k.known = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""
