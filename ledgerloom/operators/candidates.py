"""Money candidates (C1, C2), their score (R1) and order (R2); :mod:`.amounts` reads the same in a document's row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import money_to_cents, named_bucket
from ledgerloom.functions.staged import staged
from ledgerloom.functions.text import CUE_WORDS, SOFT_TOTAL, SUBTOTAL, TAX, collapse, context_summary, line_cues, total_cue, words_pattern

from .amounts import receipt_totals as receipt_totals
from .layout import document_lines, line_with_neighbours, lines_of, words_of

#: A word that is an amount; a line separator of other scripts may end it.
AMOUNT = "(?<!\\S)([0-9][0-9,]*\\.[0-9]{2})[\u0085\u2028\u2029]?(?!\\S)"


def _amount_lines(docs: DataFrame) -> DataFrame:
    """Lines of :func:`lines_of` that hold an amount, with ``_first``, the index of their first amount in the document,
    and the cents and ranks of their own; account statements have none.

    Amounts are ordered in the document's row, so that candidates need no sort, and bytes grow with the text.
    """
    cents = lambda a: F.translate(a, ",.", "").try_cast("long")
    every = F.transform("_lines", lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(AMOUNT)), lambda a, k: F.struct(i.alias("i"), k.alias("k"), cents(a).alias("cents"))))
    told = staged(document_lines(docs).where("NOT statement"), _all=F.flatten(every)).where("size(_all) > 0")
    order = F.array_sort(F.transform("_all", lambda x, j: F.struct(x.cents.isNull().alias("none"), (-x.cents).alias("less"), j.alias("j"))))
    ranks = F.array_sort(F.transform(order, lambda x, r: F.struct(x.j.alias("j"), (r + 1).alias("rank"))))
    starts = F.filter(F.transform("_all", lambda x, j: F.struct(x.i.alias("i"), x.k.alias("k"), j.alias("j"))), lambda s: s.k == 0)
    told = staged(told, _ranks=ranks, _starts=starts)
    told = staged(told, _ranks=F.col("_ranks.rank"), _cents=F.col("_all.cents"))

    def line(s: Column, n: Column) -> Column:
        own = F.coalesce(F.get("_starts", n + 1)["j"], F.size("_all")) - s.j
        return F.struct(*line_with_neighbours(s.i, F.get("_lines", s.i)), s.j.alias("_first"), F.slice("_cents", s.j + 1, own).alias("_line_cents"), F.slice("_ranks", s.j + 1, own).alias("_line_ranks"))

    return told.select("doc_id", "document_type", "n_lines", "page_width", F.inline(F.transform("_starts", line)))


def money_candidates(docs: DataFrame) -> DataFrame:
    """One row for each money word of ``docs(doc_id, text)``; account statements have none.

    Documents are dealt by id once. Cues of a line are found once for all its amounts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text").repartition(parts, "doc_id")
    # Only lines that hold an amount are cut into words, once: what rows share is a column of a stage of its own.
    lines = staged(_amount_lines(docs), words=words_of(F.col("line")))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.text.rlike("^[0-9][0-9,]*\\.[0-9]{2}$"), i)), lambda i: i.isNotNull())
    cue = lambda w: w.text.rlike("[A-Za-z]") & F.regexp_replace(w.text, "[^A-Za-z]+", "").rlike(f"(?i)^(?:{CUE_WORDS})$")
    cued = F.filter(F.transform("words", lambda w, i: F.when(cue(w), F.struct(i.alias("i"), w.x_max.alias("x_max")))), lambda c: c.isNotNull())
    lines = staged(lines, _places=places, _cues=cued, **line_cues(F.col("line_text")))
    spread = lines.select("*", F.posexplode("_places").alias("token_index", "_end"))
    word = lambda i: F.col("words")[i]
    marked = (F.col("_end") > 0) & F.coalesce(F.try_element_at("words", F.greatest("_end", F.lit(1)))["text"].rlike("(?i)^(?:₹|Rs\\.?)$"), F.lit(False))
    spread = staged(spread, has_currency=marked, _start=F.col("_end") - marked.cast("int"))
    left = collapse(F.substring("line", F.lit(1), word(F.col("_start"))["x_min"]))
    before = F.try_element_at(F.filter("_cues", lambda c: c.i < F.col("_start")), F.lit(-1))
    spread = staged(spread, left_text=left, _cue_end=before["x_max"])
    width, x_min, x_max = F.col("page_width"), word(F.col("_start"))["x_min"], word(F.col("_end"))["x_max"]
    gap = F.greatest(F.lit(0.0), (x_min - F.col("_cue_end")) / width)
    total_before = total_cue(F.col("left_text"))
    text = F.when(F.col("has_currency"), F.concat(word(F.col("_start"))["text"], F.lit(" "), word(F.col("_end"))["text"])).otherwise(word(F.col("_end"))["text"])
    out = spread.select(
        "doc_id", "document_type", "line_index", "line_text", "prev_line", "next_line", "token_index", "has_currency", "left_text",
        text.alias("amount_text"), F.get("_line_cents", F.col("token_index")).alias("amount_cents"), F.size("_places").alias("amount_count"),
        (F.col("n_lines") - F.col("line_index") - 1).alias("from_bottom"), (F.col("_end") == F.size("words") - 1).alias("rightmost"),
        total_before.alias("total_before"), F.col("left_text").rlike(words_pattern(SUBTOTAL)).alias("subtotal_before"),
        (F.col("left_text").rlike(words_pattern(TAX)) & ~total_before).alias("tax_before"), F.col("left_text").rlike(words_pattern(SOFT_TOTAL)).alias("soft_before"),
        F.when(F.col("_cue_end").isNull(), "none").otherwise(named_bucket("gap", gap)).alias("cue_gap"),
        F.when(F.col("n_lines") <= 1, "middle").otherwise(named_bucket("line_position", F.col("line_index") / F.greatest(F.col("n_lines") - 1, F.lit(1)))).alias("position"),
        named_bucket("page_vertical", F.col("line_index") / F.col("n_lines")).alias("page_y"), named_bucket("page_right", x_max / width).alias("page_right"),
        named_bucket("page_left", x_min / width).alias("page_left"), named_bucket("gap", F.greatest(F.lit(0), width - x_max) / width).alias("right_gap"),
        named_bucket("width", F.greatest(F.lit(0), x_max - x_min) / width).alias("amount_width"), named_bucket("word_count", F.size("words")).alias("row_words"),
        "total_cue", "subtotal_cue", "tax_cue", "soft_total_cue", "line_item_cue", "metadata_cue",
        (F.col("_first") + F.col("token_index")).alias("candidate_index"), F.get("_line_ranks", F.col("token_index")).alias("amount_rank"),
    )
    return out.withColumn("magnitude", named_bucket("amount", F.col("amount_cents")))


def total_score() -> Column:
    """Rule score of a money candidate."""
    # The weights below.
    c, yes = F.col, lambda cond, w: F.when(cond, w).otherwise(0)
    either = lambda name, weights: sum((yes(c(name) == v, w) for v, w in weights.items()), F.lit(0))
    several, last = c("amount_count") > 1, c("token_index") == c("amount_count") - 1
    return (
        yes(c("total_cue"), 16) + yes(c("total_before"), 9) + yes(c("soft_total_cue"), 7) + yes(c("soft_before"), 4)
        + yes(c("position") == "bottom", 3) + yes(c("page_y") == "bottom", 2) + yes(c("from_bottom") <= 3, 2) + either("amount_rank", {1: 4, 2: 2})
        + yes(last, 1) + yes(c("rightmost"), 3) + yes(c("has_currency"), 2) + either("page_right", {"edge": 6, "far_right": 4, "right": 2, "left": -7, "mid": -2})
        + either("right_gap", {"tight": 3, "near": 1}) + either("cue_gap", {"tight": 3, "near": 2}) - yes(c("subtotal_cue"), 9) - yes(c("subtotal_before"), 7)
        - yes(c("tax_cue"), 10) - yes(c("tax_before"), 8) - yes(c("line_item_cue") & ~c("total_cue") & ~c("soft_total_cue"), 7) - yes(c("metadata_cue"), 5)
        - yes(several, F.when(c("total_cue") | c("total_before"), 6).otherwise(3)) - yes(several & ~last, 3) - yes(~c("rightmost") & ~c("total_before"), 2)
    ).cast("int")


def ranked(candidates: DataFrame, scorer: Callable[[], Column] = total_score) -> DataFrame:
    """R2: candidates with ``score`` and ``rank``: score, amount and line descending, then the first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("amount_cents"), F.desc("line_index"), "candidate_index")
    return candidates.withColumn("score", scorer()).withColumn("rank", F.row_number().over(order))


def contexts(candidates: DataFrame) -> DataFrame:
    """Candidates with ``context``: buckets, flags, the first six amounts, and summaries of the lines around."""
    flag = lambda column, name: F.concat(F.lit("cue_"), F.when(F.col(column), name).otherwise(f"not_{name}"))
    named = lambda name, column: F.concat(F.lit(f"{name}_"), F.col(column).cast("string"))
    amounts = candidates.where("candidate_index < 6").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_index", F.concat_ws("_", "magnitude", "amount_rank").alias("a")))), lambda x: x.a), " ").alias("_amounts")
    )
    parts = [
        F.concat(F.lit("doc_"), F.lower(F.regexp_replace("document_type", "\\s+", "_"))), named("candidate_rank", "amount_rank"), named("candidate_magnitude", "magnitude"),
        named("candidate_line", "line_index"), named("candidate_token", "token_index"), named("candidate_from_bottom", "from_bottom"), named("candidate_position", "position"),
        named("page_right", "page_right"), named("page_left", "page_left"), named("page_y", "page_y"), named("page_gap", "right_gap"), named("amount_width", "amount_width"),
        named("row_words", "row_words"), named("cue_gap", "cue_gap"), flag("total_cue", "total"), flag("soft_total_cue", "soft_total"), flag("subtotal_cue", "subtotal"), flag("tax_cue", "tax"),
        flag("line_item_cue", "line_item"), flag("metadata_cue", "metadata"), flag("total_before", "before_total"), flag("soft_before", "before_soft_total"),
        flag("subtotal_before", "before_subtotal"), flag("tax_before", "before_tax"), F.when(F.col("amount_count") > 1, "line_multi_amount").otherwise("line_single_amount"),
        F.when(F.col("rightmost"), "word_rightmost").otherwise("word_not_rightmost"), F.when(F.col("has_currency"), "currency_marked").otherwise("currency_unmarked"),
        F.lit("top_amounts"), F.col("_amounts"), F.lit("prev"), context_summary(F.col("prev_line")), F.lit("left"), context_summary(F.col("left_text")),
        F.lit("line"), context_summary(F.col("line_text")), F.lit("next"), context_summary(F.col("next_line")),
    ]
    return candidates.hint("merge").join(amounts.hint("merge"), "doc_id").withColumn("context", F.concat_ws(" ", *parts)).drop("_amounts")


def loose_amounts(docs: DataFrame) -> DataFrame:
    """Every amount-like word, integers too, without slash or percent, and whether its line reads as an item."""
    lines = lines_of(docs.select("doc_id", "text")).where("line_text <> ''").withColumn("words", words_of(F.col("line")))
    loose = "^(?:₹|Rs\\.?)?[0-9][0-9,]*(?:\\.[0-9]{1,2})?$"
    numeric = F.size(F.filter("words", lambda w: w.text.rlike(loose)))
    letters = F.exists("words", lambda w: w.text.rlike("[A-Za-z]{2}"))
    item = ((numeric >= 3) & letters) | F.col("line_text").rlike(words_pattern("qty|quantity|rate|hsn|description|particulars"))
    each = lines.select("doc_id", "line_index", "line_text", "page_width", "n_lines", "words", item.alias("line_item_cue"), F.posexplode("words").alias("_i", "_w")).where(F.col("_w.text").rlike(loose))
    left = collapse(F.array_join(F.transform(F.slice("words", F.lit(1), F.col("_i")), lambda w: w.text), " "))
    return each.select(
        "doc_id", "line_index", F.col("_i").alias("word_index"), "line_text", "line_item_cue", F.col("_w.text").alias("amount_text"), money_to_cents(F.col("_w.text")).alias("amount_cents"),
        left.alias("left_text"), (F.col("_i") == F.size("words") - 1).alias("rightmost"), named_bucket("page_right", F.col("_w.x_max") / F.col("page_width")).alias("page_right"),
        named_bucket("page_vertical", F.col("line_index") / F.col("n_lines")).alias("page_y"),
    )


def merged_amounts(first: DataFrame, second: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """C4: one row for each line, amount and text of two lists; the second list's row wins only with more filled cues.

    ``more`` names further columns of both lists that are kept.
    """
    columns = ["doc_id", "line_index", "amount_cents", "amount_text", "left_text", "page_right", *more]
    both = first.select(*columns, F.lit(0).alias("_list")).unionByName(second.select(*columns, F.lit(1).alias("_list")))
    signals = F.coalesce((F.col("left_text") != "").cast("int"), F.lit(0)) + F.col("page_right").isNotNull().cast("int")
    order = Window.partitionBy("doc_id", "line_index", "amount_cents", "amount_text").orderBy(F.desc(signals), "_list", "left_text")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_list")
