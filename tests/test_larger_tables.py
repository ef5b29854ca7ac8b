"""What shows on larger tables: keys of six digits, and steps whose work must not be repeated."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as num
from ledgerloom.functions import text as txt
from ledgerloom.operators import candidates, datasets, layout
from ledgerloom.queries import QUERIES, SQL

from .test_queries import rows

KEYS = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_custkey"], "lineitem": ["l_suppkey"]}


@pytest.fixture(scope="module")
def shifted(spark, sf, tmp_path_factory):
    """Some orders of the smallest tables, whose parties' keys have six digits."""
    folder = str(tmp_path_factory.mktemp("shifted"))
    for name, keys in KEYS.items():
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        for order in {"orders": "o_orderkey", "lineitem": "l_orderkey"}.items():
            table = table.where(F.col(order[1]) < 150) if order[0] == name else table
        table.withColumns({k: F.col(k) + 411001 for k in keys}).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["t10_addresses", "j01_options", "j02_violations", "j03_selections"])
def test_keys_of_six_digits(name, spark, shifted):
    duck = duckdb.connect()
    for table in KEYS:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{shifted}/{table}.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, shifted).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_words_of_a_line_are_found_once(spark):
    docs = spark.createDataFrame([("1", "Total  Rs. 12.50")], "doc_id string, text string")
    plan = candidates.money_candidates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(regexp_extract_all(") == 1


def test_check_digit_reads_its_head_once(spark):
    plan = spark.range(1).select(num.make_gstin(F.col("id") + 1, F.col("id")).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lpad(") == 2 and "aggregate(" not in plan


def test_legal_values(spark):
    grids = datasets.grids(spark.createDataFrame([(k,) for k in range(30)], "o_orderkey long")).collect()
    wrong = [[9 if j % 7 else j % 12 for j in range(81)], [0] * 81]
    given = {g.o_orderkey: list(g.question) for g in grids} | {100 + i: w for i, w in enumerate(wrong)}
    want = {}
    for key, q in given.items():
        for i in (i for i in range(81) if q[i] == 0):
            peers = [j for j in range(81) if j // 9 == i // 9 or j % 9 == i % 9 or (j // 27 == i // 27 and j % 9 // 3 == i % 9 // 3)]
            want[key, i] = sorted(set(range(1, 10)) - {q[j] for j in peers})
    found = datasets.legal_values(spark.createDataFrame(list(given.items()), "o_orderkey long, question array<int>"))
    assert {(r.o_orderkey, r.cell): list(r.legal) for r in found.collect()} == want
    assert "array_except" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_collapsed_lines(spark):
    texts = ["a  b \n\t c d\n\n \n e\x0b﻿ f ", "", " x", "\r\nq  \r r", "a \n\n \n b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("plain", txt.normalize_ocr(F.col("text")))
    got = docs.select(txt.collapsed_lines(F.col("plain")).alias("a"), F.transform(F.split("plain", "\n"), txt.collapse).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_words(spark):
    line = spark.createDataFrame([(" \tab  c d\x0b e ",)], "line string")
    got = line.select(layout.words_of(F.col("line")).alias("w")).first().w
    assert [tuple(w) for w in got] == [("ab", 2, 4), ("c d", 6, 9), ("e", 11, 12)]


def test_first_letters():
    assert txt.first_letters("total|net (?:amount|sum)") == "(?=[NTnt])"
    assert txt.first_letters("s?ub|tax") == "" and txt.first_letters(".*hsn|sac") == ""


def test_words_are_counted_without_being_built(spark):
    lines = spark.createDataFrame([(" \tab  c d\x0b e ",), ("",), ("  ",), ("x",)], "line string")
    got = lines.select(layout.word_count(F.col("line")).alias("n"), F.size(layout.words_of(F.col("line"))).alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got] == [4, 0, 0, 1]
    plan = QUERIES["l01_lines_and_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_amounts_are_ordered_in_their_document(spark):
    text = "Total 12.50 3.00\n\nRs. 12.50 x1.00\n99999999999999999999.00"
    found = candidates.money_candidates(spark.createDataFrame([("1", text), ("2", "a 1.00")], "doc_id string, text string"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.orderBy("doc_id", "candidate_index").select("doc_id", "candidate_index", "line_index", "token_index", "amount_cents", "amount_rank").collect()]
    assert got == [("1", 0, 0, 0, 1250, 1), ("1", 1, 0, 1, 300, 3), ("1", 2, 2, 0, 1250, 2), ("1", 3, 3, 0, None, 4), ("2", 0, 0, 0, 100, 1)]
