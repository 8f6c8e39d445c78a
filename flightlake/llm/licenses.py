"""Known licences recognised by the digest of their canonical text.

Canonical form: copyright lines dropped, A-Z lower-cased, every run of other characters
than ASCII letters, digits and non-ASCII ones made one space, equivalent spellings made
one.  A document is looked up as a whole and line by line; what is compared is a 128-bit
digest, so the licence table joins on equality and no text is shipped.

Line matches are counted per document and licence before they meet, so a line that a third
of all rows share costs one row per document.

Defined results: null or empty text has no licence; a repeated row is one document and gets
the answer again; licences with equal canonical text all count, in order of their names; a
text of any length is read whole, and equals no licence where it is more than twice as long
as the longest; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.llm.common import KEY, ascii_lower, join_documents, keyed, scratch_table, small

# Spellings taken as equal, as (other, common) after folding.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("non commercial", "noncommercial"),
    ("http", "https"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)

# Short notices and full texts of public licences, as (licence, text).
KNOWN = (
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
        "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)

_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Titles that stand above full texts, as (licence, title).
TITLES = (
    ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"), ("ISC", "ISC License"),
    ("ISC", "The ISC License"), ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"),
)
_FULL = {"ISC": _ISC} | {name: text for name, text in KNOWN if text.startswith("Permission ")}
KNOWN = (*((name, f"{title}\n\n{_FULL[name]}") for name, title in TITLES), ("ISC", _ISC), *KNOWN)

#: A line that only says who holds the rights since when.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(?:[*#/;-]+[ \t]*)?(?:copyright\b|\(c\)|©)[^\n]*?(?:[0-9]{4}|\(c\)|©)[^\n]*"
FOLDED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, FOLDED, " "))


def _one_spelling(folded: Column) -> Column:
    """Words of ``folded`` in their common spelling, whole words only."""
    padded = F.concat(F.lit(" "), F.replace(folded, F.lit(" "), F.lit("  ")), F.lit(" "))
    out = reduce(
        lambda text, pair: F.replace(
            text,
            F.lit(f" {pair[0].replace(' ', '  ')} "),
            F.lit(f" {pair[1].replace(' ', '  ')} "),
        ),
        SPELLINGS,
        padded,
    )
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def digests(folded: DataFrame, longest: Column | int) -> DataFrame:
    """Adds ``digest`` to rows with ``folded`` text that can be as short as a known licence.

    A common spelling is at most twice as short as another, so a text more than twice as
    long as the longest known licence equals none.
    """
    return folded.where((F.length("folded") > 0) & (F.length("folded") <= 2 * F.lit(longest))).withColumn(
        "digest", F.md5(_one_spelling(F.col("folded")).cast("binary"))
    )


def license_table(licenses: DataFrame) -> DataFrame:
    """``(digest, license, length)`` of a table ``(license, text)``."""
    lower = ascii_lower(F.coalesce("text", F.lit("")))
    folded = licenses.select("license", _folded(F.regexp_replace(lower, COPYRIGHT_LINE, " ")).alias("folded"))
    return (
        folded.where(F.length("folded") > 0)
        .select("license", F.md5(_one_spelling(F.col("folded")).cast("binary")).alias("digest"),
                F.length(_one_spelling(F.col("folded"))).alias("length"))
        .distinct()
    )


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """``KEY, text_licenses, line_licenses, n_lines`` of every document.

    ``text_licenses``: licences whose text is the whole document; ``line_licenses``: those
    that are one of its lines; ``n_lines``: lines that are a licence.
    """
    table = scratch_table(license_table(licenses), "licenses")
    bounds = table.agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    longest, known = bounds["longest"] or 0, small(table.select("digest", "license"), bounds["n"])
    text = ascii_lower(F.coalesce("text", F.lit("")))
    rights = keyed(docs).select(*KEY, F.regexp_replace(text, COPYRIGHT_LINE, " ").alias("body"), text.alias("lower"))

    whole = digests(rights.select(*KEY, _folded(F.col("body")).alias("folded")), longest)
    lines = digests(
        rights.select(*KEY, F.posexplode(F.split("lower", "\n")).alias("pos", "line"))
        .where(F.length("line") > 0)
        .select(*KEY, "pos", _folded(F.col("line")).alias("folded")),
        longest,
    )
    in_text = whole.join(known, "digest").groupBy(*KEY).agg(
        F.sort_array(F.collect_set("license")).alias("text_licenses")
    )
    in_lines = lines.join(known.groupBy("digest").agg(F.collect_set("license").alias("of")), "digest").groupBy(
        *KEY
    ).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("line_licenses"),
        F.size(F.collect_set("pos")).alias("n_lines"),
    )
    none = F.array().cast("array<string>")
    everything = join_documents(join_documents(keyed(docs).select(*KEY), in_text), in_lines)
    return everything.select(
        *KEY,
        F.coalesce("text_licenses", none).alias("text_licenses"),
        F.coalesce("line_licenses", none).alias("line_licenses"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
    )


def licenses_of(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """``scan`` with the licences as text, one row per document."""
    return scan(docs, licenses).select(
        "doc_id",
        F.array_join("text_licenses", ",").alias("text_licenses"),
        F.array_join("line_licenses", ",").alias("line_licenses"),
        F.col("n_lines").alias("n_license_lines"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_folded(text: str) -> str:
    return f"trim(regexp_replace({text}, {_sql_text(FOLDED)}, ' ', 'g'))"


def _sql_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_spelled(folded: str) -> str:
    out = f"' ' || replace({folded}, ' ', '  ') || ' '"
    for other, common in SPELLINGS:
        other, common = other.replace(" ", "  "), common.replace(" ", "  ")
        out = f"replace({out}, ' {other} ', ' {common} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _sql_body(text: str) -> str:
    return f"regexp_replace({text}, {_sql_text(COPYRIGHT_LINE)}, ' ', 'g')"


_SQL_KNOWN = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in KNOWN)
ORACLE = f"""
WITH known AS (SELECT DISTINCT license, {_sql_spelled(_sql_folded(_sql_body(_sql_lower("text"))))} AS canon
               FROM (VALUES {_SQL_KNOWN}) AS t(license, text)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lower("coalesce(text, '')")} AS low FROM documents),
whole AS (SELECT r, {_sql_spelled(_sql_folded(_sql_body("low")))} AS canon FROM docs),
lines AS (SELECT r, {_sql_spelled(_sql_folded("line"))} AS canon
          FROM (SELECT r, unnest(string_split(low, chr(10))) AS line FROM docs)),
by_text AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS l FROM whole JOIN known USING (canon) GROUP BY r),
by_line AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS l FROM lines JOIN known USING (canon) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM lines WHERE canon IN (SELECT canon FROM known) GROUP BY r)
SELECT doc_id, coalesce(t.l, '') AS text_licenses, coalesce(b.l, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM docs LEFT JOIN by_text t USING (r) LEFT JOIN by_line b USING (r) LEFT JOIN counts USING (r)
"""
