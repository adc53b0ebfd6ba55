"""Document elements: cleaning, role hints, HTML tables, and their contiguous position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import BLOCK_ROWS, blocked_row_number
from ragloom.functions.text import blank, clean

# Role hints looked up in upper-cased text.
ROLE_HINTS = ["PRÜFUNGSSTELLE", "PRÜFUNGSAUSSCHUSS", "PRA", "STUDIERENDENBÜRO", "DEKANAT", "SENAT"]

# Check-box glyphs that mark a form.
CHECKBOX_GLYPHS = ["☐", "□", "○", "☑", "☒", "◯", "◻"]

EMPTY_CELL_SHARE = 0.4
LABEL_SHARE = 0.5


def clean_elements(elements: DataFrame) -> DataFrame:
    return elements.withColumn("text", clean(F.col("text")))


def tag_roles(elements: DataFrame, hints: Sequence[str] = ROLE_HINTS) -> DataFrame:
    """Add `roles`, the hints contained in the upper-cased text."""
    none = F.array().cast("array<string>")
    if not hints:
        return elements.withColumn("roles", none)
    # Outside a lambda the upper-cased text is computed once a row and not once a hint.
    upper = F.upper(F.coalesce("text", F.lit("")))
    found = [F.when(F.contains(upper, F.lit(hint)), F.array(F.lit(hint))).otherwise(none) for hint in hints]
    return elements.withColumn("roles", F.flatten(F.array(*found)))


def _cell_text(cell: Column) -> Column:
    """Text of a cell: tags and the blanks around them dropped, common entities decoded."""
    text = F.regexp_replace(cell, r"(?s)\s*<[^>]*>\s*", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), r"(?U)^\s+|\s+$", "")


def _split_at(html: Column, tag: str) -> Column:
    """The pieces after each opening `tag`."""
    pieces = F.split(html, rf"(?i)<{tag}\b[^>]*>")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def _cells(html: Column) -> Column:
    return F.transform(_split_at(html, "t[dh]"), _cell_text)


def _rows(html: Column) -> Column:
    return F.transform(_split_at(html, "tr"), _cells)


def is_form(html: Column) -> Column:
    """A table is a form when many cells are empty, a check box occurs, or most rows start with a label."""
    cells = _cells(html)
    empty = F.size(F.filter(cells, lambda c: F.length(c) == 0))
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    glyph = F.lit(False)
    for sign in CHECKBOX_GLYPHS:
        glyph = glyph | F.contains(text, F.lit(sign))
    heads = F.transform(F.filter(_rows(html), lambda r: F.size(r) > 0), lambda r: r[0])
    labels = F.size(F.filter(heads, lambda h: h.endswith(":") | h.endswith("*")))
    return (F.size(cells) > 0) & (
        (empty / F.size(cells) > EMPTY_CELL_SHARE)
        | glyph
        | ((F.size(heads) > 0) & (labels / F.nullif(F.size(heads), F.lit(0)) > LABEL_SHARE))
    )


def table_text(html: Column) -> Column:
    """Pipe-separated rows with a header line; empty for forms and tables without text."""
    filled = F.filter(_rows(html), lambda r: F.exists(r, lambda c: F.length(c) > 0))
    lines = F.transform(filled, lambda r: F.array_join(r, " | "))
    columns = F.size(F.split(lines[0], r" \| "))
    rule = F.array_join(F.array_repeat(F.lit("---"), columns), " | ")
    with_header = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines)))
    return (
        F.when(is_form(html) | (F.size(lines) == 0), F.lit(""))
        .when(F.size(lines) == 1, lines[0])
        .otherwise(F.array_join(with_header, "\n"))
    )


def classify_tables(tables: DataFrame) -> DataFrame:
    """Add `is_form` to (…, html)."""
    return tables.withColumn("is_form", is_form(F.col("html")))


def tables_to_text(tables: DataFrame) -> DataFrame:
    """Add `table_text` to (…, html)."""
    return tables.withColumn("table_text", table_text(F.col("html")))


def prepare_elements(elements: DataFrame) -> DataFrame:
    """Clean, turn tables to text, drop what is left empty, tag roles, number the rest 0.. per document in `idx`."""
    is_table = (F.col("element_type") == "Table") & (F.length("table_html") > 0)
    # Text is tested before tables are expanded: a table element without any text is dropped.
    rows = clean_elements(elements).filter(~blank(F.col("text")))
    rows = tag_roles(rows).withColumn(
        "text", F.when(F.coalesce(is_table, F.lit(False)), table_text(F.col("table_html"))).otherwise(F.col("text"))
    )
    rows = rows.filter(F.length("text") > 0)
    numbered = blocked_row_number(
        rows, ["document_id"], F.floor(F.col("pos") / BLOCK_ROWS), [F.col("pos")], "idx"
    )
    return numbered.withColumn("idx", F.col("idx") - 1)
