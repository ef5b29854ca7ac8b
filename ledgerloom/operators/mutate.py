"""Mutation of texts (M1-M3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a letter is mistaken for, and how often in hundredths.
NOISE = {"O": ("0", 55), "I": ("1", 45), "S": ("5", 30), "A": ("4", 15)}


def ocr_noise(text: Column, key: Column, seed: int) -> Column:
    """M1: letters become look-alike digits where a draw, a hash of seed, key and place, falls below their rate."""
    def one(c: Column, i: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("long") % 100
        out = F
        for letter, (digit, rate) in NOISE.items():
            out = out.when((c == letter) & (draw < rate), digit)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _first(lines: Column, pattern: str) -> Column:
    """Number from 1 of the first line that matches, 0 without one."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")


def replace_line(text: Column, pattern: str, new: list[str]) -> Column:
    """M2: the first line that matches gives way to ``new``."""
    lines = F.split(text, "\n")
    at = _first(lines, pattern)
    changed = F.concat(F.slice(lines, F.lit(1), at - 1), F.array(*[F.lit(x) for x in new]), F.slice(lines, at + 1, F.size(lines)))
    return F.when(at > 0, F.array_join(changed, "\n")).otherwise(text)


def insert_line(text: Column, pattern: str, new: str, after: bool) -> Column:
    """M3: ``new`` stands before or after the first line that matches."""
    lines = F.split(text, "\n")
    at = _first(lines, pattern)
    head = at if after else at - 1
    changed = F.concat(F.slice(lines, F.lit(1), head), F.array(F.lit(new)), F.slice(lines, head + 1, F.size(lines)))
    return F.when(at > 0, F.array_join(changed, "\n")).otherwise(text)


def cases(bases: DataFrame, mutations: list[tuple[str, str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """M4: each of ``bases(doc_id, text)`` as it is (class ``control``) and under each mutation."""
    told = F.array(
        F.struct(F.lit("control").alias("failure_class"), F.lit("none").alias("mutation"), F.col("text").alias("text")),
        *[F.struct(F.lit(c).alias("failure_class"), F.lit(n).alias("mutation"), f(F.col("text"), F.col("doc_id")).alias("text")) for c, n, f in mutations],
    )
    return bases.select("doc_id", F.explode(told).alias("c")).select("doc_id", "c.*")


#: The mutations of the robustness set.
MUTATIONS = [
    ("ocr", "noise", lambda text, key: ocr_noise(text, key, 1)),
    ("layout", "header", lambda text, key: insert_line(text, ".", "PAGE 1 OF 1", False)),
    ("layout", "blank", lambda text, key: insert_line(text, "(?i)total", "", False)),
    ("label", "total", lambda text, key: F.regexp_replace(text, "(?i)grand total|\\btotal\\b", "Net Amount")),
    ("distractor", "phone", lambda text, key: insert_line(text, "(?i)invoice", "Phone 98.76", True)),
    ("distractor", "discount", lambda text, key: insert_line(text, "(?i)invoice", "Discount offered 5.00", True)),
]
