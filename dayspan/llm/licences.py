"""Licence scans by canonical digest.

A text is brought to a canonical form: lower case, copyright lines and a title line dropped, equivalent spellings made one,
and everything but letters and digits turned into single spaces, so that wrapping makes no difference. The digest of the
canonical form is joined with the digests of the known licences' texts: the whole text for licence files, and each line of
a document for one-line notices.

A copyright line names a year, a sign or a holder; a line of running text that begins with the word by the chance of
wrapping stays. The known texts are a small fixed table (or the caller's); the join is by digest, and Spark decides how to
run it. Lines are only digested if they hold the longest word of some known text (``probe_words``), which depends on the
known table alone. Null or empty texts have no licence. Rows of equal id are separate documents. If two known ids share a
text, the first in order is given. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, and the lines that name a right's holder.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
             ("analogue", "analog"), ("authorisation", "authorization"), ("favour", "favor"), ("organisation", "organization"),
             ("per cent", "percent"), ("noncommercial", "non commercial"), ("merchantibility", "merchantability"), ("https", "http")]
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )[^\n]*|©[^\n]*|\(c\)[ \t]*([0-9]{4}|copyright)[^\n]*|"
    r"\(c\)([ \t]+[^ \t\n]+){1,5}[ \t]*|all rights reserved[^\p{L}\p{N}\n]*)$"
)
TITLE_LINE = (
    r"\A\s*(the )?([\p{L}\p{N}.\-]+ ){0,2}(lesser general public |affero general public |general public |public |software )?licen[cs]e"
    r"( \([\p{L}\p{N}.\- ]{1,20}\))?,?( (version )?v?[0-9.]+)?[ \t]*\n"
)

#: Known licence texts and one-line notices, by SPDX id.
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR_DISCLAIMS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_DISCLAIMS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AUTHOR_DISCLAIMS),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause-notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0-notice", "Licensed under the GNU General Public License, Version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR_DISCLAIMS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\n" + _NO_WARRANTY),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
              '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
              "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
              "so.\n" + _NO_WARRANTY),
    ("BSD-2-Clause", _REDISTRIBUTION + _BSD_DISCLAIMS),
    ("BSD-3-Clause", _REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission.\n" + _BSD_DISCLAIMS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must "
             "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly "
             "marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any "
             "source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
                "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to "
                "the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction "
                "and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
                "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
                "language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
                "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT "
                "HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
                "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                          "License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable "
                          "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
                          "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                          "limitations under the License."),
    ("GPL-3.0-or-later-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                                "version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                                "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
                                "details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see "
                                "<https://www.gnu.org/licenses/>."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("MIT-notice", "Released under the MIT License."),
]


def canonical(text: Column) -> Column:
    """Canonical form of a text; empty for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    plain = F.regexp_replace(plain, TITLE_LINE, "")
    # Two spaces between words, so that neighbours don't share the space that a replacement takes up.
    spaced = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    same = reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, spaced)
    return F.trim(F.replace(same, F.lit("  "), F.lit(" ")))


def probe_words(known: DataFrame, most: int = 200) -> list[str] | None:
    """Longest words of the known texts, one of each, that no other spelling touches; None if there are more than ``most``.

    A text equal to a known one in canonical form holds its word.
    """
    touched = sorted({w for pair in SPELLINGS for spelling in pair for w in spelling.split(" ")})
    words = F.filter(F.split(canonical(F.col("text")), " "), lambda w: ~w.isin(*touched) & (w != ""))
    longest = F.get(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0))
    found = [r[0] for r in known.select(F.coalesce(longest, F.lit("")).alias("w")).distinct().limit(most + 1).collect()]
    return found if len(found) <= most and "" not in found else None


def digest(text: Column) -> Column:
    """Digest of the canonical form, or null if nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence_id string, text string")


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, canonical_sha256, licence_id of the whole text, and the ids of its notice lines, sorted and comma-joined."""
    known = known_licences(docs.sparkSession) if known is None else known
    digests = known.select(digest(F.col("text")).alias("d"), "licence_id").where("d is not null").groupBy("d").agg(F.min("licence_id").alias("licence_id"))
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    probes = probe_words(known)
    probe = "|".join(probes) if probes else r"\p{L}|\p{N}"
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(probe)))
    notices = (
        docs.select(*key, F.explode(lines).alias("line")).select("doc_id", "text_hash", digest(F.col("line")).alias("d"))
        .join(digests, "d").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("notices"))
    )
    rows = docs.select(*key, digest(F.col("text")).alias("canonical_sha256"))
    return (
        rows.join(digests, rows["canonical_sha256"] == digests["d"], "left")
        .join(notices, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "canonical_sha256", "licence_id", F.coalesce("notices", F.lit("")).alias("notices"))
    )
