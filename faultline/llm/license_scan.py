"""Licence scan by canonical digests: whole texts, normalised, joined to known texts by hash.

Normalising takes away what differs between copies of one licence: case,
copyright lines, comment marks, punctuation, list numbers' dots, white space,
and spellings that mean the same.  The digest (SHA-256) of what is left is
joined by equality to the digests of the known texts, which the same functions
normalise, so no list of digests has to be kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import whole_text
from faultline.llm.license_texts import KNOWN

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Spellings that licence comparison guidelines treat as one, after normalising.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("fulfil ", "fulfill "),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("initialise", "initialize"),
    ("utilisation", "utilization"),
    ("wilful ", "willful "),
    ("https ", "http "),
)
# a line that begins with a copyright mark, after lower-casing and comment marks
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
COMMENT_MARK = r"(^|\n)[ \t]*(/\*+|\*+/|\*|//+|#+|;+|--+|<!--|rem )"


def canonical(text: Column) -> Column:
    """The normalised text; null counts as empty."""
    t = F.translate(text, UPPER + "\r\f\v", UPPER.lower() + "\n\n\n")
    t = F.regexp_replace(t, COMMENT_MARK, "\n")
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    # quotes, dashes and all other ASCII punctuation separate words
    t = F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”«»–—…•\x{A0}]+", " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """(known_digest, license) of the known texts; of texts with one digest, the first name by order."""
    table = spark.createDataFrame(list(known), "name string, body string")
    return table.groupBy(digest(F.col("body")).alias("known_digest")).agg(F.min("name").alias("license"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, canonical_sha256, canonical_chars, license (null if the whole text is no known one).

    A null or empty text, or one of punctuation only, has an empty canonical
    form and matches nothing.  Repeated rows repeat their result, an empty
    table gives none, other columns take no part.  Texts are compared whole; a
    licence inside a longer text is no match.
    """
    rows = docs.select(F.col(key).alias("__key"), canonical(whole_text(text)).alias("__text"))
    rows = rows.select("__key", F.sha2("__text", 256).alias("canonical_sha256"), F.length("__text").cast("bigint").alias("canonical_chars"))
    listed = known.filter(F.col("known_digest") != F.sha2(F.lit(""), 256))
    joined = rows.join(listed, F.col("canonical_sha256") == F.col("known_digest"), "left")
    return joined.select(F.col("__key").alias(key), "canonical_sha256", "canonical_chars", "license")


def canonical_sql(expression: str) -> str:
    """The same normalisation as DuckDB text, for checks."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate({expression}, '{UPPER}' || chr(13) || chr(12) || chr(11), '{UPPER.lower()}' || chr(10) || chr(10) || chr(10))"
    for pattern, new in ((COMMENT_MARK, "chr(10)"), (COPYRIGHT_LINE, "chr(10)"), (r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”«»–—…•\x{A0}]+", "' '")):
        t = f"regexp_replace({t}, {quoted(pattern)}, {new}, 'g')"
    t = f"' ' || trim({t}, ' ') || ' '"
    for old, new in SPELLINGS:
        t = f"replace({t}, {quoted(old)}, {quoted(new)})"
    return f"trim({t}, ' ')"
