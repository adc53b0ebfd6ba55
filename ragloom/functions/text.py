"""Column expressions for text; everything stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pattern shared by BM25, content F1 and ROUGE-L.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

# Stop words that content F1 ignores.
STOP_WORDS = [
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "eines", "und", "oder", "aber", "wenn",
    "weil", "dass", "ob", "als", "wie", "ist", "sind", "war", "waren", "wird", "werden", "wurde", "wurden",
    "hat", "haben", "hatte", "hatten", "kann", "können", "muss", "müssen", "soll", "sollen", "will", "wollen",
    "darf", "dürfen", "ich", "du", "er", "sie", "es", "wir", "ihr", "mein", "dein", "sein", "unser", "euer",
    "dieser", "diese", "dieses", "jener", "jene", "jenes", "nicht", "auch", "nur", "noch", "schon", "sehr",
    "mehr", "mit", "von", "zu", "bei", "nach", "für", "aus", "an", "auf", "in", "über", "unter", "vor",
    "hinter", "neben", "zwischen", "durch", "gegen", "ohne", "um", "hier", "dort", "da", "wo", "wann", "warum",
    "was", "wer", "welche", "welcher", "so", "also", "doch", "ja", "nein", "vielleicht", "etwa", "wohl",
]


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(F.rlike(text, F.lit(r"(?U)\S")), F.lit(False))


def or_null(text: Column) -> Column:
    """Null instead of an empty string."""
    return F.when(F.length(text) > 0, text)


def clean(text: Column) -> Column:
    """Drop soft hyphens, re-join words split at a line end, strip blanks before a newline."""
    bare = F.replace(text, F.lit("­"), F.lit(""))
    joined = F.regexp_replace(bare, r"(?U)-\n(\w)", "$1")
    # Both patterns need a newline, which most lines don't have.
    return F.when(F.contains(bare, F.lit("\n")), F.regexp_replace(joined, r"[ \t]+\n", "\n")).otherwise(bare)


def joined_in_order(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: concatenate the texts of a (bounded) group by `order`."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)
