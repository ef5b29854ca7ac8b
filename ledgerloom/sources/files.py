"""Readers and writers of files (S1-S5, S7-S9). All work on any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TSV_HEADER = "level\tpage_num\tpar_num\tblock_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
GRID_SCHEMA = "source string, question string, answer string, rating double"
INVOICE_SCHEMA = "currency string, taxRate double, items array<struct<label:string,quantity:double,unitPrice:double>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, format, text)``, one row for each file; the format is ``tsv`` where the word header leads."""
    files = spark.read.text(path, wholetext=True)
    head = F.ltrim("value").startswith(TSV_HEADER)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.when(head, "tsv").otherwise("text").alias("format"), F.col("value").alias("text"))


def tsv_words(docs: DataFrame) -> DataFrame:
    """Words of ``docs(doc_id, text)`` in TSV form, with their page's size; short rows are skipped.

    Rows of level 1 give pages, rows of level 5 words; a document's pages and words stay in its row until both are known.
    """
    rows = F.filter(F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.split(x, "\t")), lambda c: F.size(c) >= 12)
    number = lambda c, i: c[i].try_cast("double")
    told = docs.where(F.ltrim("text").startswith(TSV_HEADER)).select("doc_id", rows.alias("_rows"))
    pages = F.transform(F.filter("_rows", lambda c: c[0] == "1"), lambda c: F.named_struct(F.lit("page"), c[1], F.lit("width"), number(c, 8), F.lit("height"), number(c, 9)))
    words = told.select("doc_id", pages.alias("_pages"), F.posexplode(F.filter("_rows", lambda c: (c[0] == "5") & (F.trim(c[11]) != ""))).alias("word_index", "_c"))
    page = F.try_element_at(F.filter("_pages", lambda p: p.page == F.col("_c")[1]), F.lit(1))
    left, top = F.col("_c")[6].try_cast("double"), F.col("_c")[7].try_cast("double")
    return words.select(
        "doc_id", (F.col("_c")[1].try_cast("int") - 1).alias("page_index"), "word_index", F.col("_c")[11].alias("text"), left.alias("x_min"), (left + F.col("_c")[8].try_cast("double")).alias("x_max"),
        top.alias("y_min"), (top + F.col("_c")[9].try_cast("double")).alias("y_max"), page["width"].alias("page_width"), page["height"].alias("page_height"),
    )


def parse_invoices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices of ``docs(doc_id, text)`` in JSON, and the rejected documents with their reason.

    Defaults: USD, rate 0, ``Item n``. Items need a positive quantity and a price that is not negative.
    """
    told = docs.withColumn("v", F.from_json("text", INVOICE_SCHEMA, {"mode": "PERMISSIVE"}))
    bad_items = lambda check: F.exists("v.items", lambda x: F.coalesce(check(x), F.lit(True)))
    reason = (
        F.when(F.col("v").isNull() | F.coalesce(F.size("v.items") <= 0, F.lit(True)), "no items")
        .when(bad_items(lambda x: x.quantity <= 0), "quantity").when(bad_items(lambda x: x.unitPrice < 0), "price").when(F.coalesce(F.col("v.taxRate") < 0, F.lit(False)), "rate")
    )
    told = told.withColumn("reason", reason)
    items = F.transform("v.items", lambda x, i: F.struct(F.coalesce(x.label, F.concat(F.lit("Item "), i + 1)).alias("label"), F.floor(x.quantity * 1000 + 0.5).cast("long").alias("thousandths"), F.floor(x.unitPrice * 100 + 0.5).cast("long").alias("unit_cents")))
    good = told.where("reason IS NULL").select("doc_id", F.coalesce("v.currency", F.lit("USD")).alias("currency"), F.floor(F.coalesce("v.taxRate", F.lit(0.0)) * 10000 + 0.5).cast("int").alias("tax_bp"), items.alias("items"))
    return good, told.where("reason IS NOT NULL").select("doc_id", "text", "reason")


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Puzzle rows ``(source, question, answer, rating)``; malformed rows end the read with an error."""
    return spark.read.schema(GRID_SCHEMA).csv(path, header=True, escape='"', mode="FAILFAST")


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split."""
    rows.write.partitionBy(split).mode("overwrite").json(path)


def write_shards(rows: DataFrame, path: str, shard_rows: int) -> DataFrame:
    """Parquet files of at most ``shard_rows`` rows; returns ``(file, rows)``."""
    rows.write.option("maxRecordsPerFile", shard_rows).mode("overwrite").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def manifest(rows: DataFrame, settings: dict[str, str], split: str = "split", label: str | None = None) -> DataFrame:
    """One row with the settings, counts by split, and labels."""
    counts = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "n")))).alias("counts"), F.sum("n").alias("total"))
    if label:
        one = one.crossJoin(rows.select(label).distinct().agg(F.array_sort(F.collect_list(label)).alias("labels")))
    return one.select(F.create_map(*[F.lit(x) for kv in sorted(settings.items()) for x in kv]).alias("settings"), "*")


def first_rows(rows: DataFrame, n: int, index: str) -> DataFrame:
    """The first ``n`` rows in file order."""
    return rows.orderBy(index).limit(n)


def numbered(rows: DataFrame, order: list[str], block: str) -> DataFrame:
    """Row numbers from 1 in the order of ``order``, counted within blocks whose offsets are added."""
    sizes = rows.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(block)) - F.col("_n")).drop("_n")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(block).orderBy(*order)))
    return ranked.join(before, block).withColumn("row_index", F.col("_before") + F.col("_r")).drop("_before", "_r")
