"""Amounts read in a document's row, as the expressions of candidates state them."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import words_pattern
from ledgerloom.operators import amounts, candidates, vouchers
from ledgerloom.operators.render import read_order_documents, read_voucher_documents
from ledgerloom.queries import QUERIES

ODD = [
    None, "", " ", "\n\n", "no amount", "Total 12.50 3.00\n\nRs. 12.50 x1.00\n99999999999999999999.00", "a 1.00", "Total  ₹ 1,23,456.00  5.00  ", "Total 1.00 \n2.00  Rs.\u0085 7.25\u0085",
    "Bank statement\nBalance 10.00", "x\n1/2/2024 debit 1.00\n02-Jan-24 credit 2.00\n3 March 2024 7.00\nclosing balance 9.00", "TAX INVOICE\naccount statement\nTotal 5.00", "﻿Sub  Total  8.00\r\nTax Amount 1.00 total 9.00\rGST 18% 1.50",
    "Grand Total 5.00\nGrand Total 5.00", "1 item 2.00 2.00 2.00\n" * 3 + "amount due: 6.00", "QTY 2 pcs rate 1.5 Rs 3 ₹4.50 Rs.5.5 6, 7.123 8%\n12.00 12.00", "Kelvin K totaſ 3.00\nİ dr 4.00 cr 2.125", "\x0b Total \x0c 1.00 \x1c 2.00 　 3.00",
    "a" * 500 + " total 7.00", "Paid 4.00 Rs\n" + "word " * 200 + "9.99", "0012.00 ,12.00 1,2,3.00 12.000 1.2.00", "Total\t5.00\tRs\t6.00", "\U0001f600 total 1.00 \U0001f600", "​Total​ 2.00",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(f"odd{i}", t) for i, t in enumerate(ODD)], "doc_id string, text string")
    first = F.col("doc_id").cast("long") < 200
    own = read_order_documents(spark, sf).where(first).select("doc_id", "text").unionByName(read_voucher_documents(spark, sf).where(first).select(F.concat(F.lit("v"), "doc_id").alias("doc_id"), "text"))
    return odd.unionByName(own).repartition(4).localCheckpoint()


@pytest.fixture(scope="module")
def money(docs):
    return candidates.money_candidates(docs).localCheckpoint()


def same(got, want):
    got, want = ([tuple(r) for r in x.select(*sorted(got.columns)).collect()] for x in (got, want))
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got)


def test_totals_are_those_of_the_ranked_candidates(docs, money):
    want = candidates.ranked(money).where("rank = 1").select("doc_id", "document_type", F.col("amount_cents").alias("total_cents"), "line_index", "score")
    same(amounts.receipt_totals(docs), want)


def test_contexts_are_those_of_the_candidates(docs, money):
    same(amounts.contexts(docs), candidates.contexts(money).select("doc_id", F.col("candidate_index").cast("int").alias("candidate_index"), "context"))


def test_cued_amounts_are_the_candidates(docs, money):
    same(amounts.cued_amounts(docs), money.select("doc_id", "amount_cents", "total_cue"))


def test_kept_amounts_are_those_of_the_merge(docs, money):
    merged = candidates.merged_amounts(money, candidates.loose_amounts(docs.where("text NOT LIKE '%9999999999%'")))
    same(amounts.kept_amounts(docs), money.join(merged, ["doc_id", "line_index", "amount_cents", "amount_text"], "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("strict")))


def test_merge_has_the_rows_of_the_expressions(spark, docs, money):
    fine = docs.where("text NOT LIKE '%9999999999%'")
    want = {(r.doc_id, r.line_index, r.amount_cents, r.amount_text, r.left_text) for r in candidates.merged_amounts(candidates.money_candidates(fine), candidates.loose_amounts(fine)).collect()}
    got = set()
    for r in fine.collect():
        doc = amounts.document(r.text.encode() if r.text is not None else None)
        for (i, cents, text), (rank, _) in amounts.merged(doc).items():
            got.add((r.doc_id, i, cents, text, rank[2]))
    assert got == want


def test_rows_of_one_document_have_one_total(spark):
    found = amounts.receipt_totals(spark.createDataFrame([(1, "Total 2.00"), (1, "Total 3.00"), (None, "Total 4.00")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.total_cents) for r in found.collect() if r.doc_id) == [(1, 300)] and found.count() == 2


@pytest.mark.parametrize("name", ["c04_merged_amounts", "c12_contexts", "r02_receipt_totals", "e05_rule_accuracy", "d03_labelled_amounts", "c07_amount_fields"])
def test_texts_are_read_in_their_own_row(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "RepartitionByExpression [doc_id" not in plan


def by_expressions(docs):
    """C7 over tables: candidates of the amount fields by cues, and the six best totals."""
    line, left = F.coalesce("line_text", F.lit("")), F.coalesce("left_text", F.lit(""))

    def score(words, base):
        yes = lambda c, n: F.when(c, n).otherwise(0)
        return (
            base + yes(line.rlike(words_pattern(words)), 18) + yes(left.rlike(words_pattern(words)), 10) + yes(F.col("rightmost"), 2)
            + yes(F.col("page_right").isin("edge", "far_right"), 2) + yes(F.col("page_y") == "bottom", 2) - yes(F.col("line_item_cue"), 5)
        )

    def made(field, points, source):
        return F.struct(
            F.lit(field).alias("field"), F.lit(None).cast("string").alias("value"), F.col("amount_cents").alias("num"), points.cast("int").alias("score"), F.lit(source).alias("source"),
            F.col("line_index").cast("int").alias("line_index"), F.col("line_text"), F.col("amount_text").alias("display"),
        )

    out = []
    for field, words, base, both in vouchers.AMOUNT_CUES:
        met = line.rlike(words_pattern(words)) | (left.rlike(words_pattern(words)) if both else F.lit(False))
        out.append(F.when(met, made(field, score(words, base), "amount_cue")))
    total = line.rlike(words_pattern(vouchers.TOTAL_CUE)) | left.rlike(words_pattern(vouchers.TOTAL_CUE))
    weak = ~total & ~F.col("line_item_cue") & (F.col("amount_cents") >= 100000) & F.col("rightmost") & ((F.col("page_y") == "bottom") | (F.col("page_right") == "edge"))
    out.append(F.when(weak, made("amounts.grand_total_cents", score(vouchers.TOTAL_CUE, 30), "weak_amount_fallback")))
    tax = line.rlike(words_pattern(vouchers.TAX_LINE)) & ~line.rlike(words_pattern("igst|cgst|sgst|cess")) & ~F.col("line_item_cue")
    out.append(F.when(tax, made("amounts.taxable_amount_cents", score(vouchers.TAX_LINE, 22), "weak_tax_fallback")))
    money = candidates.money_candidates(docs)
    by_cue = candidates.merged_amounts(money, candidates.loose_amounts(docs), ("line_text", "rightmost", "page_y", "line_item_cue")).select("doc_id", F.explode(F.array_compact(F.array(*out))).alias("_c"))
    best = candidates.ranked(money).where("rank <= 6").select("doc_id", made("amounts.grand_total_cents", 72 + F.col("score"), "total_ranker").alias("_c"))
    return by_cue.unionByName(best).select("doc_id", "_c.*")


def test_amount_fields_are_those_of_the_expressions(docs):
    fine = docs.where("text NOT LIKE '%9999999999%'")
    want = by_expressions(fine).localCheckpoint()
    same(vouchers.amount_candidates(fine), want)
    same(vouchers.first_amounts(fine), vouchers.in_order(want).where("rank = 1").select("doc_id", "field", "num"))
