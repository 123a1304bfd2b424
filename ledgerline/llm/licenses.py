"""Operator 6: licence lookup by canonical digest.

A text is brought to canonical form: lower case, punctuation as space, lines
of a copyright statement dropped, equivalent spellings made one, white space
collapsed.  The SHA-256 digest of the whole canonical text is hash-joined to
the digests of known licence texts; the digest of every single canonical line
is looked up among known one-line notices.  All of it is DataFrame functions;
the known digests are a fixed table, so the join needs no exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.known_licenses import LICENSES, NOTICES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”–—… \t\r\x0b\x0c"
#: Spellings read as equal, after punctuation has become space.
SPELLINGS = [
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https", "http"),
]
COPYRIGHT = "^(portions )?(c )?copyright (c|by|[0-9]{4})( .*)?$|^c [0-9]{4}( .*)?$|^all rights reserved$"


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty lines and copyright lines."""
    t = F.translate(F.replace(text, F.lit("©"), F.lit("(c)")), UPPER + PUNCTUATION, LOWER + " " * len(PUNCTUATION))
    t = F.regexp_replace(t, " +", " ")
    t = reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), SPELLINGS, t)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def known(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license_id and digest of known texts (a fixed, small table)."""
    rows = spark.createDataFrame(list(texts.items()), "license_id string, text string")
    return rows.select("license_id", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"))


def scan(docs: DataFrame, licenses: dict[str, str] = LICENSES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id (of the whole text, or NULL), notices (ids of one-line
    notices, sorted, comma-joined), n_notices (lines) per row.

    NULL and empty texts match nothing.  Rows are independent: repeats are
    repeated, an empty table is empty; extra columns are ignored.  Known
    licences must have distinct canonical texts (checked).
    """
    spark = docs.sparkSession
    table = known(spark, licenses).collect()  # the fixed table
    of_line = {r["digest"]: r["license_id"] for r in known(spark, notices).collect()}
    if len({r["digest"] for r in table}) < len(licenses) or len(of_line) < len(notices):
        raise ValueError("two known texts have one canonical form")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("lines"))
    lookup = F.create_map(*[F.lit(x) for pair in of_line.items() for x in pair])
    found = F.filter(F.transform("lines", lambda x: F.try_element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
    d = d.select(
        "doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"),
        F.size(found).cast("long").alias("n_notices"),
    )
    return d.join(F.broadcast(spark.createDataFrame(table, "license_id string, digest string")), "digest", "left").select(
        "doc_id", "license_id", "notices", "n_notices"
    )
