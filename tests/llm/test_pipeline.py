"""The pipeline's stages over a small table: columns stay, decisions take effect."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.common import materialize
from ledgerloom.llm.queries import mixing_rates


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        counts[name] = out.count()
        if name != "packing":
            assert out.columns == columns
        if name == "secrets":
            assert counts[name] == docs.count()
            assert out.where("text RLIKE 'AKIA[A-Z0-9]{16}' OR text RLIKE '[0-9a-f]{24}'").count() == 0
        docs = out
    assert counts["near_copies"] < counts["toxicity"] <= before
    full = docs.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in full) and sum(r[1] for r in full) > 0.8 * 4096 * len(full)


def test_mixing_meets_its_targets(spark, sf):
    """The expected tokens of each domain under the rates have the wanted shares."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.hint("merge").join(labels.where("toxic = 1").select("doc_id").hint("merge"), "doc_id", "left_anti")
    rated = mixing_rates(clean, labels, corpus_pipeline.MIX)
    total = rated.agg(F.sum("n_tokens")).first()[0]
    reached = rated.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")) / total for d in corpus_pipeline.MIX]).first()
    assert list(reached) == pytest.approx(list(corpus_pipeline.MIX.values()), rel=0.01)


def test_stages_on_awkward_rows(spark, sf):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, and columns that operators use."""
    text = " ".join(f"word{i % 97} other{i % 89}" for i in range(6000))
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "short"), (3, "short"), (4, text), (5, text), (6, text + " end"), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None, 7, 8.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, _rate double").coalesce(1)
    for table in (docs, docs.limit(0)):
        now = materialize(table, "test")
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, sf), name)
            if name != "packing":
                assert now.columns == docs.columns
            if name == "near_copies":
                assert sorted((t or "" for t in (r["text"] for r in now.collect())), key=len) == (sorted(["", "no id here", "short", text], key=len) if table is docs else [])
        assert (now.count() > 0) == (table is docs)
