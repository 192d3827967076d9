"""Licence scans by canonical digests of entire texts.

A text is brought into a canonical form (lower case; equivalent spellings; copyright lines and
punctuation dropped; white space collapsed) and its SHA-256 is joined by hash with the digests of
known licences. Beside the entire document, each entire line is looked up too, as notices are lines.

Defined results: a null or empty text has the digest of the empty form and fits nothing; repeated
rows are scanned alike; an empty table gives no rows. Two known texts with one canonical form are
one licence, the first by name. ``scan`` takes other lists of texts and of canonical digests, which
may come from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.components import spread
from tidemark.llm.store import saved

# Spellings that are taken as the same, as (pattern, replacement), applied in order to lower-case words.
SPELLINGS = [
    ("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"),
    ("honour", "honor"), ("colour", "color"), ("analyse", "analyze"), ("judgement", "judgment"),
    ("merchantibility", "merchantability"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("https://", "http://"),
]
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Known licence texts and notices, (name, text).
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


# SHA-256 of the canonical form of long licences' entire texts, as their stewards publish them; (name, digest).
KNOWN_DIGESTS = [
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
#: Known texts and digests up to this many (about 100 bytes each) are broadcast, more are joined by shuffle; lengths of texts up to that many are planned as a list.
MOST_BROADCAST, MOST_SIZES = 200_000, 1000


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line: lower-case words in one spelling, with single spaces."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """``(digest, license, size)`` of texts (license, text) and of canonical digests (license, digest), as lists or tables; size is null for the latter."""
    of = lambda given, schema: given if isinstance(given, DataFrame) else spark.createDataFrame(list(given), schema)
    rows = of(known, "license string, text string").select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("form"))
    rows = rows.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("size"))
    told = of(digests, "license string, digest string").select("license", "digest").withColumn("size", F.lit(None).cast("int"))
    return rows.unionByName(told).groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"))


def scan(docs: DataFrame, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """Per document: digest of its canonical form, the licence it is as a whole, and those its lines name.

    The canonical form is computed once, where the text is read: what is left of it, the digests of
    the whole and of lines as long as a known text, is written and then meets the known ones in hash
    joins, by broadcast or, beyond MOST_BROADCAST of them, in salted tasks.
    """
    table = saved(known_digests(docs.sparkSession, known, digests), "licences")
    n, sizes = table.count(), [r[0] for r in table.select("size").dropna().distinct().limit(MOST_SIZES + 1).collect()]
    # the generators keep the lines in one evaluation
    one = docs.select("doc_id", F.explode(F.array(canonical_lines(F.col("text")))).alias("lines"))
    looked = F.filter("lines", lambda x: F.length(x).isin(sizes)) if len(sizes) <= MOST_SIZES else F.col("lines")
    digest = lambda x: F.sha2(x, 256)
    one = one.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.array_join("lines", " ")).alias("digest"), F.array_distinct(F.transform(looked, digest)).alias("hits"))
    one = saved(one, "digests")

    def meet(rows: DataFrame, against: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(against), "digest", how) if n <= MOST_BROADCAST else spread(rows, against, ["digest"], "row", how)

    lines = one.select("row", F.explode("hits").alias("digest"))
    named = meet(lines, table.filter("size is not null").select("digest", F.col("license").alias("name")), "inner")
    named = named.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))
    out = meet(one.drop("hits"), table.select("digest", "license"), "left").join(named, "row", "left")
    return out.select("doc_id", "digest", "license", "notices")
