"""Parties (L8, L9): names near tax numbers, and the role of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import GSTIN
from ledgerloom.functions.text import normalize_ocr, split_columns, words_pattern

from .layout import lines_of

COMPANY = "LLP|LTD|LIMITED|PRIVATE LIMITED|PVT\\.?\\s+LTD"
#: Where a name is looked for, in order.
OFFSETS = (-1, -2, -3, 1, 2, 3, -4, 4)
# Headings that begin a party's part.
BUYER_HEADING, SELLER_HEADING = "^(?:buyer|bill to|billed to|sold to|customer|client)", "^(?:seller|supplier|vendor|sold by|from)"


def company_name(line: Column) -> Column:
    """First column of a line that names a company, else null."""
    return F.when(line.rlike(words_pattern(COMPANY)), F.try_element_at(split_columns(line), F.lit(1)))


def nearest_names(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_index, gstin, name)`` for each line with a GSTIN; a document's lines stay in its row."""
    lines = docs.select("doc_id", F.split(normalize_ocr(F.coalesce("text", F.lit(""))), "\n").alias("_lines"))
    pattern = f"(?<![A-Za-z0-9_])({GSTIN})(?![A-Za-z0-9_])"
    each = lines.select("doc_id", "_lines", F.posexplode("_lines").alias("line_index", "line")).where(F.col("line").rlike(pattern))
    at = lambda o: F.when(F.col("line_index") + o >= 0, company_name(F.get("_lines", F.col("line_index") + o)))
    return each.select("doc_id", "line_index", F.regexp_extract("line", pattern, 1).alias("gstin"), F.coalesce(*[at(o) for o in OFFSETS]).alias("name"))


def roles(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_index, role)``: the last heading at or above a line, else seller in the first ten lines."""
    lines = lines_of(docs.select("doc_id", "text"))
    told = F.when(F.col("line_text").rlike(f"(?i){BUYER_HEADING}"), "buyer").when(F.col("line_text").rlike(f"(?i){SELLER_HEADING}"), "seller")
    above = Window.partitionBy("doc_id").orderBy("line_index")
    role = F.coalesce(F.last(told, ignorenulls=True).over(above), F.when(F.col("line_index") < 10, "seller"))
    return lines.select("doc_id", "line_index", role.alias("role"))
