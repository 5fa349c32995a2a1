"""Licence scans: digests of texts in canonical form, hash-joined to those of known licences.

The canonical form is in lower case, without copyright lines, punctuation and differences of white space, and with one
spelling for words that have several. A document is looked up as a whole, and so is each of its lines, for
short notices stand among other text. DataFrame functions only; nothing is shuffled but a large catalogue.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A catalogue of at most so many entries is broadcast (64-character digests and names: about 2 MB).
BROADCAST_ROWS = 10_000

#: What a line may begin with that speaks of copyright, but not of who holds it.
TERM = r"^([^\p{L}\n]*)Copyright([ \t]+(?:Act|Holder|Interest|Law|Licence|License|Notice|Owner|Statement))"
#: A line that only says who holds the copyright, as a name; and the same with a sign or a year (after lower case).
NAMED = r"^[^\p{L}\n]*Copyright[ \t]+(?:by[ \t]+)?\p{Lu}\p{Ll}[^\n]*$"
COPYRIGHT = r"^[^\p{L}\n]*(?:copyright[ \t]*(?:\(c\)|©)|copyright[ \t:]*[0-9<\[{]|©|\(c\)[ \t]*[0-9<\[{])[^\n]*$"
#: Spellings that mean the same.
SPELLINGS = {
    "licence": "license",
    "sub license": "sublicense",
    "organisation": "organization",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "behaviour": "behavior",
    "honour": "honor",
    "wilful": "willful",
    "fulfilment": "fulfillment",
    "recognise": "recognize",
    "authorise": "authorize",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "whilst": "while",
}
PHRASES = ("all rights reserved",)

#: Well-known licences and notices, by their public identifiers.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", MIT),
    ("MIT", f"MIT License\n{MIT}"),
    ("MIT", f"The MIT License (MIT)\n{MIT}"),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_REST}"),
    ("ISC", f"ISC License\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_REST}"),
    ("0BSD", f"{ISC_GRANT}.\n{ISC_REST}"),
    ("BSD-2-Clause", f"{BSD_GRANT}\n{BSD_REST}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{BSD_GRANT}\n{BSD_REST}"),
    ("BSD-3-Clause", f"{BSD_GRANT}\n{BSD_THIRD}\n{BSD_REST}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{BSD_GRANT}\n{BSD_THIRD}\n{BSD_REST}"),
    ("Zlib", ZLIB),
    ("Zlib", f"zlib License\n{ZLIB}"),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


#: Digests of the canonical forms of long licences' full texts, as their stewards publish them.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3-only", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def _wrapped(words: str) -> str:
    """A pattern for ``words`` that may stand on two lines."""
    return words.replace(" ", r"[ \n]+")


def _same() -> list[tuple[str, str]]:
    return [*((phrase, "") for phrase in PHRASES), *SPELLINGS.items()]


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, but with its line ends."""
    named = F.regexp_replace(F.regexp_replace(text, f"(?md){TERM}", "$1copyright$2"), f"(?md){NAMED}", "")
    out = F.lower(F.when(F.contains(text, F.lit("Copyright")), named).otherwise(text))
    out = F.regexp_replace(out, f"(?md){COPYRIGHT}", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for word, same in _same():
        out = F.regexp_replace(out, _wrapped(word), same) if " " in word else F.replace(out, F.lit(word), F.lit(same))
    return out


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def canonical_text(text: str) -> str:
    """The same form of a Python string, for catalogues."""
    import regex

    out = regex.sub(NAMED, "", regex.sub(TERM, r"\1copyright\2", text, flags=regex.M), flags=regex.M).lower()
    out = regex.sub(COPYRIGHT, "", out, flags=regex.M)
    out = regex.sub(r"[^\p{L}\p{N}\n]+", " ", out)
    for word, same in _same():
        out = regex.sub(_wrapped(word), same, out)
    return " ".join(out.split())


def catalogue() -> dict[str, str]:
    """Digest of the canonical form to identifier; the first entry of a digest counts."""
    out = {digest: name for name, digest in DIGESTS}
    for name, text in KNOWN:
        out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return out


def known_digests(spark: SparkSession, licenses: DataFrame | None = None) -> DataFrame:
    """``digest``, ``license_id`` of ``licenses`` (``license_id``, ``text``), or of the catalogue here. One row a digest: the least identifier."""
    if licenses is None:
        return spark.createDataFrame(sorted(catalogue().items()), "digest string, license_id string")
    digest = F.sha2(whole(canonical_lines(F.col("text"))), 256)
    return licenses.where(F.col("text").isNotNull()).select(digest.alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row a document: ``doc_id``, ``text_digest``, ``license_id`` of the whole text (null: none known), and
    ``notices``, the identifiers of its lines that are a known notice, each once, in order, comma-joined.

    A null or empty text, and one of punctuation or copyright lines only, has the digest of the empty string, which
    isn't a licence's. Repeated rows are taken each; other columns are ignored. With a catalogue of one's own only
    whole texts are looked up; one beyond BROADCAST_ROWS isn't broadcast.
    """
    own = common.OWN
    known = known_digests(docs.sparkSession, licenses)
    if licenses is None or known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select("doc_id", canonical_lines(common.text_of()).alias(f"{own}lines"))
    lines = F.transform(F.split(f"{own}lines", "\n"), lambda x: F.trim(x))
    rows = rows.select("doc_id", F.sha2(whole(F.col(f"{own}lines")), 256).alias("text_digest"), F.filter(lines, lambda x: x != "").alias(f"{own}lines"))
    if licenses is None:
        names = catalogue()
        table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
        digests = F.array_intersect(F.transform(f"{own}lines", lambda x: F.sha2(x, 256)), F.array(*map(F.lit, sorted(names))))
        notices = F.array_join(F.array_sort(F.array_distinct(F.transform(digests, lambda d: table[d]))), ",")
    else:
        notices = F.lit("")
    rows = rows.select("doc_id", "text_digest", notices.alias("notices"))
    empty = hashlib.sha256(b"").hexdigest()
    return rows.join(known.where(F.col("digest") != empty), F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "license_id", "notices")


def oracle() -> str:
    """The scan with the catalogue here as DuckDB SQL."""
    lines = rf"regexp_replace(coalesce(text, ''), '(?m){TERM}', '\1copyright\2', 'g')"
    lines = f"regexp_replace({lines}, '(?m){NAMED}', '', 'g')"
    lines = f"regexp_replace(lower({lines}), '(?m){COPYRIGHT}', '', 'g')"
    lines = rf"regexp_replace({lines}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for word, same in _same():
        lines = f"regexp_replace({lines}, '{_wrapped(word)}', '{same}', 'g')" if " " in word else f"replace({lines}, '{word}', '{same}')"
    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(catalogue().items()))
    return rf"""
WITH known(digest, license_id) AS (VALUES {known}),
forms AS (SELECT doc_id, row_number() OVER () AS n, {lines} AS lines FROM documents),
texts AS (SELECT doc_id, n, lines, sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))) AS text_digest FROM forms),
parts AS (SELECT DISTINCT n, k.license_id FROM (SELECT n, unnest(string_split(lines, chr(10))) AS line FROM forms) l JOIN known k ON sha256(trim(l.line)) = k.digest),
notices AS (SELECT n, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM parts GROUP BY n)
SELECT doc_id, text_digest, license_id, coalesce(notices, '') AS notices
FROM texts LEFT JOIN known ON text_digest = digest LEFT JOIN notices USING (n)"""
