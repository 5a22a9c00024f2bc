"""Licence scan by canonical digest: normalised texts are hash-joined with the digests of known licences.

Normalising a line: lower-case A-Z, drop it if it is a copyright line, turn all but letters and digits to single blanks.
A text is its lines joined by blanks, with equivalent spellings made one. Its SHA-256 is looked up among the known digests;
so is that of each of its lines, for notices of one line in a longer text. Only DataFrame functions.

Known texts are a table (license_id, text) of any size: digests are joined by hash, and Spark sends the table to all tasks
only where its statistics prove it small; otherwise the join meets on digests, and Spark splits one that very many lines have.
Without a table of the caller's they are KNOWN: the entire texts in ``known_licenses.jsonl``, a file of the package that the
driver reads, with each of their titles and without one, with and without appendix, in the wordings, addresses and links in
use, and notices of one line.
A document's digests are gathered with combinable aggregates under a number of its row, so no source or line is a key.

Null text counts as empty: it has the digest of the empty text, which no licence has. Repeated rows each give a row, empty
tables give empty results, other columns are not read.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscan.llm.common import ascii_lower

COPYRIGHT_LINE = r"^[^a-z0-9©]*(?:copyright[^a-z0-9©]*(?:\(c\)|©|[12][0-9][0-9][0-9]|c [12][0-9][0-9][0-9]|year|yyyy)|\(c\)[^a-z0-9]*[12][0-9][0-9][0-9]|©|all rights reserved\.?[^a-z0-9]*$)"
NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: Spellings that licence matching treats as equal.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("favour", "favor"),
    ("behaviour", "behavior"), ("honour", "honor"), ("organisation", "organization"), ("recognise", "recognize"), ("authorisation", "authorization"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("whilst", "while"), ("wilful", "willful"),
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of each title, body and ending of the data file, as they stand and after each list of replacements."""
    out = {}
    for row in map(json.loads, pkgutil.get_data(__package__, "known_licenses.jsonl").decode("utf-8").rstrip("\n").split("\n")):
        for title in row["titles"]:
            for body in row["bodies"]:
                for ending in row["endings"]:
                    text = "\n".join(x for x in (title, body, ending) if x)
                    for pairs in ([], *row["instead"]):
                        other = text
                        for a, b in pairs:
                            other = other.replace(a, b)
                        out[row["license_id"], other] = None
    return tuple(out)


#: Public licence texts and notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
KNOWN = (
    ("MIT", f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"""ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    *whole_texts(),
)


def canonical_line(low: Column) -> Column:
    """Of a line in lower case; empty for a copyright line. A cheap search stands before the pattern."""
    maybe = F.exists(F.array(*[F.lit(m) for m in ("copyright", "(c)", "©", "all rights")]), lambda m: F.contains(low, m))
    return F.when(maybe & low.rlike(COPYRIGHT_LINE), "").otherwise(F.trim(F.regexp_replace(low, NOT_ALNUM, " ")))


def spelled(text: Column) -> Column:
    for variant, usual in SPELLINGS:
        text = F.replace(text, F.lit(variant), F.lit(usual))
    return text


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), canonical_line), lambda x: x != "")


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license_id and digest of a table of known texts, each digest once."""
    known = known if known is not None else spark.createDataFrame(list(KNOWN), "license_id string, text string")
    digest = F.sha2(spelled(F.array_join(canonical_lines(F.col("text")), " ")), 256)
    return known.select("license_id", digest.alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: canonical_sha256, license_id of the whole text (or null), n_license_lines, line_licenses."""
    digests = known_digests(docs.sparkSession, known)
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).withColumn("uid", F.monotonically_increasing_id())
    rows = rows.select("uid", "doc_id", F.sha2(spelled(F.array_join("lines", " ")), 256).alias("canonical_sha256"), F.transform("lines", lambda x: F.sha2(spelled(x), 256)).alias("lines"))
    each = rows.select("uid", "doc_id", "canonical_sha256", F.posexplode(F.concat(F.array("canonical_sha256"), "lines")).alias("place", "digest"))
    found = each.join(digests, "digest", "left")
    hit = F.when(F.col("place") > 0, F.col("license_id"))
    out = found.groupBy("uid", "doc_id", "canonical_sha256").agg(
        F.max(F.when(F.col("place") == 0, F.col("license_id"))).alias("license_id"), F.count(hit).alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set(hit)), ",").alias("line_licenses")
    )
    return out.drop("uid")
