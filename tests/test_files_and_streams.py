"""Readers, writers and streams against what went in."""

from pyspark.sql import functions as F

from ledgerloom.operators.candidates import receipt_totals
from ledgerloom.operators.render import read_order_documents
from ledgerloom.operators.states import STATES, canonical_states
from ledgerloom.plans.receipts import receipts
from ledgerloom.sources import files
from ledgerloom.streaming.documents import stream_grids, stream_totals

GRID = 'source,question,answer,rating\na,"1,2",x,50\nb,q2,"say ""hi""",5\nc,q3,z,90\n'


def test_texts_and_tsv_words(spark, tmp_path):
    (tmp_path / "one.txt").write_text("TOTAL 1.00\nend")
    rows = [["1", "1", "0", "0", "0", "0", "0", "0", "600", "800", "-1", "###PAGE###"], ["5", "1", "0", "0", "0", "0", "10", "20", "30", "8", "100", "Total"], ["5", "1", "short"]]
    (tmp_path / "two.tsv").write_text(files.TSV_HEADER + "\n" + "\n".join("\t".join(r) for r in rows))
    docs = files.read_texts(spark, str(tmp_path))
    assert sorted(r["format"] for r in docs.collect()) == ["text", "tsv"]
    words = files.tsv_words(docs).collect()
    assert [tuple(w)[1:] for w in words] == [(0, 0, "Total", 10.0, 40.0, 20.0, 28.0, 600.0, 800.0)]


def test_invoices_are_checked(spark):
    docs = spark.createDataFrame([(1, '{"items":[{"quantity":1.5,"unitPrice":2.25}]}'), (2, '{"items":[]}'), (3, '{"items":[{"quantity":0,"unitPrice":1}]}'), (4, "not json"), (5, '{"items":[{"quantity":1,"unitPrice":-1}]}'), (6, None)], "doc_id long, text string")
    good, bad = files.parse_invoices(docs)
    assert [tuple(r) for r in good.collect()] == [(1, "USD", 0, [("Item 1", 1500, 225)])]
    assert {r["doc_id"]: r["reason"] for r in bad.collect()} == {2: "no items", 3: "quantity", 4: "no items", 5: "price", 6: "no items"}


def test_grids_splits_shards_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.csv").write_text(GRID)
    rows = files.read_grids(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in rows.orderBy("source").collect()] == [("a", "1,2", "x", 50.0), ("b", "q2", 'say "hi"', 5.0), ("c", "q3", "z", 90.0)]
    many = spark.range(1000).withColumn("split", F.when(F.col("id") % 10 == 0, "eval").otherwise("train"))
    files.write_splits(many, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).groupBy("split").count().count() == 2
    shards = files.write_shards(many.coalesce(1), str(tmp_path / "shards"), 300).collect()
    assert sorted(r["rows"] for r in shards) == [100, 300, 300, 300]
    one = files.manifest(many, {"limit": "5"}).collect()
    assert len(one) == 1 and one[0]["counts"] == {"eval": 100, "train": 900} and one[0]["total"] == 1000
    told = files.numbered(many.withColumn("block", F.floor(F.col("id") / 300)), ["id"], "block").collect()
    assert all(r["row_index"] == r["id"] + 1 for r in told)


def test_grid_stream_equals_batch_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = lambda: sorted(r["source"] for r in spark.read.json(str(tmp_path / "out")).collect())
    run = lambda: stream_grids(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), 10, 50).awaitTermination(120)
    (tmp_path / "in" / "g.csv").write_text(GRID)
    run()
    assert out() == ["a", "c"]
    (tmp_path / "in" / "h.csv").write_text(GRID.replace("c,q3", "d,q4"))
    run()
    run()
    assert out() == ["a", "a", "c", "d"]


def test_total_stream_equals_batch(spark, sf, tmp_path):
    docs = read_order_documents(spark, sf).limit(20).collect()
    (tmp_path / "in").mkdir()
    for r in docs:
        (tmp_path / "in" / f"{r['doc_id']}.txt").write_text(r["text"])
    (tmp_path / "in" / "bad.txt").write_text("nothing here")
    stream_totals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), 8).awaitTermination(300)
    got = {r["doc_id"].rpartition("/")[2].removesuffix(".txt"): (r["total_cents"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["doc_id"]: (r["total"], None) for r in docs} | {"bad": (None, "no total found")}


def test_statements_have_no_candidates(spark):
    docs = spark.createDataFrame([("s", "Bank Statement\n01/02/2024 opening balance 10.00\n02/02/2024 debit 1.00\nTotal 11.00"), ("r", "Cafe\nTotal 11.00"), ("n", None)], "doc_id string, text string")
    assert [(r["doc_id"], r["total_cents"]) for r in receipt_totals(docs).collect()] == [("r", 1100)]


def test_receipt_plan(spark, sf):
    got = receipts(read_order_documents(spark, sf)).groupBy("family", "status").count().collect()
    assert {(r["family"], r["status"]) for r in got} == {("proforma_invoice", "PASS"), ("sales_invoice", "UNCHECKED")}


def test_states_are_whole():
    assert len(STATES) == 35 and len({c for c, _ in STATES}) == 35


def test_states_by_alias(spark):
    names = {"Bhubaneswar, Orissa": "21", "PONDICHERRY 605001": "34", "Pondichery": "34", "New Delhi": "07", "Andaman & Nicobar Islands": "35", "Nowhere": None}
    places = spark.createDataFrame([(n,) for n in names], "place string")
    assert {r["place"]: r["code"] for r in canonical_states(places, "place").collect()} == names
