"""License scans by canonical digests.

A text is made canonical (lower case, no copyright lines nor title line, whatever comment
marks are before them, equivalent spellings as one, everything but letters and digits as
one space) and its SHA-256 is joined with the
digests of known licences, made by the same rule: a table of one row per known text, which is
``KNOWN`` and the files in ``license_texts``, or a table of the caller's. The SQL knows
``KNOWN`` alone, by ``RULES``. Notices are often one line of a longer text, so each distinct
line is a text of its own in the same join. What is found belongs to a text, by two 64-bit
hashes, and comes back to the documents that have it; texts in which nothing is found are met
by no row. Known digests, and texts in which something is found, are sent to all tasks where
they are few, and joined by a shuffle where not; neither reaches the driver.

Null and empty texts have no licence (null) and no lines (empty list); a text of any length is
read whole. Repeated rows get the same answer each. Columns ``license`` and ``line_licenses``
of the input are replaced, all others stay, whatever their names. Of two names of one known
text the first in order counts; null names and texts are none. Empty tables of documents give
no row, and an empty table of licences finds nothing.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.tables import written

#: Licence identifiers and texts or notices they are known by.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)
#: Patterns and what takes their place, in this order, after lower-casing.
RULES = (
    (r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", " "),
    (r"all rights reserved", " "),
    (r"[^a-z0-9]+", " "),
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement", "noninfringement"),
    (r"\bper cent\b", "percent"),
)
#: The scan's rules: a line that starts as a sentence about copyright holders or notices isn't a copyright line, however a text is wrapped.
SCAN_RULES = (
    (r"(?m)^[^a-z0-9\n]*?(copyright(?![a-z]|[ \t]+(holder|owner|notice|licen[cs]e|law|interest|statement|disclaimer|and|or|in|to|on|is)s?\b)|\(c\)|©)[^\n]*$", " "),
    (r"\A[^a-z0-9]*(the[ \t]+)?(mit|isc|expat|x11|unlicense|bsd[ \t]+[234]-clause|[234]-clause[ \t]+bsd|(new|modified|revised|simplified)[ \t]+bsd)([ \t]+licen[cs]e)?([ \t]*\([^)\n]*\))?[^a-z0-9\n]*\n", " "),
    *RULES[1:],
)


#: The most rows that are sent to all tasks.
FEW = 20_000


def canonical(text: str, rules: tuple = RULES) -> str:
    text = text.lower()
    for pattern, by in rules:
        text = re.sub(pattern, by, text)
    return text.strip()


def digests() -> dict[str, str]:
    """SHA-256 of the canonical text to the licence's identifier."""
    return {hashlib.sha256(canonical(text).encode()).hexdigest(): name for name, text in KNOWN}


def known_digests() -> dict[str, str]:
    """The scan's digests of KNOWN and of the full texts, each file named by its licence."""
    files = sorted(Path(__file__).with_name("license_texts").glob("*.txt"))
    texts = [*KNOWN, *((f.stem, f.read_text()) for f in files)]
    return {hashlib.sha256(canonical(text, SCAN_RULES).encode()).hexdigest(): name for name, text in texts}


def canonical_column(text: Column) -> Column:
    out = F.lower(text)
    for pattern, by in SCAN_RULES:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def table_digests(known: DataFrame) -> DataFrame:
    """The digests of a table license, text."""
    keyed = known.where("license is not null").select("license", canonical_column(F.col("text")).alias("c")).where("c <> ''")
    return keyed.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("name"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """By the known texts, a table license, text or those of this package: the documents with ``license``, of the whole text, and ``line_licenses``, distinct and sorted, of its lines."""
    spark = docs.sparkSession
    docs = docs.drop("license", "line_licenses")
    table = spark.createDataFrame(sorted(known_digests().items()), "digest string, name string") if known is None else table_digests(known)
    text = F.coalesce("text", F.lit(""))
    of = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), of.alias("of"))
    digest = lambda x: F.sha2(canonical_column(x), 256)
    asked = F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(text).alias("digest"))), F.transform(F.array_distinct(F.split(text, "\n")), lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))))
    met = docs.select(of.alias("of"), F.explode(asked).alias("x")).select("of", "x.whole", "x.digest").join(_few(table), "digest")
    names = F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("name"))))  # as many as there are licences, at most
    found = written(met.groupBy("of").agg(F.min(F.when(F.col("whole"), F.col("name"))).alias("license"), names.alias("line_licenses")), "license-texts")
    none = F.expr("cast(array() as array<string>)")
    return keyed.join(_few(found), "of", "left").select("doc.*", "license", F.coalesce("line_licenses", none).alias("line_licenses"))


def _few(df: DataFrame) -> DataFrame:
    """The frame, to be sent to all tasks if it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def oracle_sql() -> str:
    def canon(x: str) -> str:
        x = f"lower({x})"
        for pattern, by in RULES:
            x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
        return f"trim({x})"

    pairs = ", ".join(f"('{d}', '{n}')" for d, n in sorted(digests().items()))
    return f"""
        WITH known(digest, license) AS (VALUES {pairs}),
        lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        found AS (SELECT l.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS names
                  FROM lines l JOIN known k ON sha256({canon('l.line')}) = k.digest GROUP BY 1)
        SELECT d.doc_id, k.license, coalesce(f.names, '') AS line_licenses
        FROM documents d LEFT JOIN known k ON sha256({canon('d.text')}) = k.digest LEFT JOIN found f ON f.doc_id = d.doc_id"""
