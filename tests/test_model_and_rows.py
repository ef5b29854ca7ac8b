"""The fitted ranker (R14) and row clustering (L2)."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import candidates, datasets, layout, model
from ledgerloom.operators.datasets import group_split
from ledgerloom.operators.render import read_order_documents


def test_ranker_finds_totals_of_unseen_documents(spark, sf):
    docs = read_order_documents(spark, sf)
    rows = candidates.contexts(candidates.money_candidates(docs)).join(docs.select("doc_id", "total"), "doc_id")
    rows = rows.withColumn("label", (F.col("total_cue") & (F.col("amount_cents") == F.col("total"))).cast("double"))
    told = group_split(rows.select("doc_id", "candidate_index", "context", "label"), "doc_id", 0.3).cache()
    fitted = model.fit_ranker(told.where("split = 'train'"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("model_score"), "candidate_index")
    top = model.scored(fitted, told.where("split = 'eval'")).withColumn("r", F.row_number().over(best)).where("r = 1")
    n, right = top.agg(F.count("*"), F.sum("label")).first()
    assert n > 300 and right / n >= 0.95


def test_words_join_rows_by_running_mean(spark):
    words = [("d", 0, "Total", 10.0, 40.0, 100.0, 110.0), ("d", 0, "12.00", 90.0, 120.0, 102.0, 112.0), ("d", 0, "next", 10.0, 30.0, 120.0, 130.0), ("d", 1, "page", 1.0, 2.0, 1.0, 9.0)]
    frame = spark.createDataFrame(words, "doc_id string, page_index int, text string, x_min double, x_max double, y_min double, y_max double")
    got = sorted((r["page_index"], r["row_index"], r["text"], r["n_words"]) for r in layout.cluster_rows(frame).collect())
    assert got == [(0, 0, "Total 12.00", 2), (0, 1, "next", 1), (1, 0, "page", 1)]


def test_group_split_ranks_no_whole_table(spark, monkeypatch):
    def ranked(self, *columns, **more):
        raise AssertionError("all groups are ranked at once")

    keys = [i // 2 for i in range(1000)]
    rows = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k int")
    hashes = sorted(hashlib.md5(f"7:{k}".encode()).hexdigest() for k in set(keys))
    with monkeypatch.context() as m:
        for name in ("orderBy", "sort", "limit"):
            m.setattr(type(rows), name, ranked)
        got = {r["k"] for r in group_split(rows, "k", 0.1).where("split = 'eval'").collect()}
        assert got == {k for k in keys if hashlib.md5(f"7:{k}".encode()).hexdigest() <= hashes[49]}
        assert group_split(rows.where("k < 0"), "k", 0.1).count() == 0
        table = spark.createDataFrame([(h,) for h in hashes], "_h string")
        for ratio, rank in ((0.0, 1), (0.1, 50), (0.555, 277), (1.0, 500)):
            assert datasets.hash_at(table, ratio, digits=1, most=2) == hashes[rank - 1]
