"""Streams (X1, X2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.candidates import receipt_totals
from ledgerloom.operators.datasets import hash_split
from ledgerloom.operators.records import extract, to_json
from ledgerloom.operators.stored import stored
from ledgerloom.sources.files import GRID_SCHEMA


def stream_grids(spark: SparkSession, source: str, sink: str, checkpoint: str, least_rating: float, percent: int, files: int = 16) -> StreamingQuery:
    """Puzzle CSV files as they come, filtered by rating, split by key, written as JSON by split, exactly once."""
    rows = spark.readStream.schema(GRID_SCHEMA).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files).csv(source)
    kept = rows.where(F.col("rating") >= least_rating).withColumn("split", hash_split(F.col("question"), percent))
    return kept.writeStream.format("json").partitionBy("split").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_totals(docs: DataFrame) -> DataFrame:
    """``(doc_id, total_cents, error)`` for every document; one without a total has an error instead of stopping."""
    found = receipt_totals(docs).select("doc_id", "total_cents")
    return docs.select("doc_id").hint("merge").join(found.hint("merge"), "doc_id", "left").withColumn("error", F.when(F.col("total_cents").isNull(), "no total found"))


def stream_totals(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Totals of text files as they come; a batch that runs again replaces its own output."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files).load(source)
    docs = rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        extract_totals(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What cannot be read is told apart before any parser sees it.
BLANK, BINARY = "the document has no text", "the document is a PDF, not its text"


def total_results(docs: DataFrame) -> dict[str, DataFrame]:
    """``results(doc_id, total_cents)`` and ``errors(doc_id, error)``."""
    told = stored(extract_totals(docs))
    return {"results": told.where("error IS NULL").drop("error"), "errors": told.where("error IS NOT NULL").select("doc_id", "error")}


def record_results(docs: DataFrame) -> dict[str, DataFrame]:
    """``results(doc_id, record)`` with records as JSON, and ``errors(doc_id, error)`` of the rejected documents."""
    told = extract(docs)
    return {"results": to_json(told.records), "errors": told.rejected.select("doc_id", F.coalesce("reason", F.lit("not supported")).alias("error"))}


def results(docs: DataFrame, reader: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """What ``reader`` finds in ``docs(doc_id, text)``, every document being in exactly one of the two tables.

    ``errors(doc_id, error, text)`` keeps the text for another attempt. Null and blank texts and PDF files are errors
    that the reader is not asked for, and so is a document that it passes over.
    """
    text = F.coalesce("text", F.lit(""))
    bad = F.when(~text.rlike("\\S"), BLANK).when(F.col("doc_id").rlike("(?i)\\.pdf$") | F.substring("text", 1, 5).eqNullSafe("%PDF-"), BINARY)
    told = stored(docs.select("doc_id", "text", bad.alias("error")))
    good = told.where("error IS NULL").drop("error")
    found = {k: stored(v) for k, v in reader(good).items()}
    named = found["errors"].unionByName(told.where("error IS NOT NULL").select("doc_id", "error"))
    missed = good.select("doc_id", "text").hint("merge").join(found["results"].select("doc_id").hint("merge"), "doc_id", "left_anti")
    quarantine = missed.unionByName(told.where("error IS NOT NULL").select("doc_id", "text")).hint("merge").join(named.hint("merge"), "doc_id", "left")
    return {"results": found["results"], "errors": quarantine.select("doc_id", F.coalesce("error", F.lit("nothing found")).alias("error"), "text")}


def stream_results(
    spark: SparkSession, source: str, sink: str, checkpoint: str, reader: Callable[[DataFrame], dict[str, DataFrame]] = record_results, files: int = 1000,
) -> StreamingQuery:
    """Documents as they come, to ``sink/results`` and ``sink/errors``.

    Both are partitioned by batch; a batch that runs again, after a failure between its two writes too, replaces its own
    output, so each document is in exactly one of them once. A bad document is an error row and stops nothing.
    """
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files).load(source)
    docs = rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        for name, table in results(batch, reader).items():
            table.write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
