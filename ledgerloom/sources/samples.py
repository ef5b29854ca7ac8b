"""Sample sets by their manifest (S6): samples within it, JSON lines by split, or packed Parquet shards."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the forms and of a manifest's files, and the widths of a sample's arrays.
INLINE, LINES, PACKED = "structured-state-v1", "structured-state-v1-jsonl", "structured-state-v1-parquet"
MANIFEST, PACKED_MANIFEST = "-manifest.json", "-packed-manifest.json"
WIDTHS = {"boardTokens": 81, "candidateMask": 9, "historyOps": 8}
SAMPLE = "boardTokens array<int>, focusRow int, focusCol int, candidateMask array<int>, historyOps array<int>, filledCount int, searchDepth int, label int"


@dataclass
class SampleSet:
    train: DataFrame
    eval: DataFrame
    counts: dict[str, int | None]
    labels: list[str]
    metadata: dict = field(default_factory=dict)


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system, or None where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.text(path, wholetext=True).first()[0] if system.exists(hadoop) else None


def _checked(rows: DataFrame) -> DataFrame:
    """Samples whose arrays have their widths and hold no null; another one ends the read with an error that says which."""
    for name, width in WIDTHS.items():
        sound = (F.size(name) == width) & ~F.exists(name, lambda v: v.isNull())
        told = F.concat(F.lit(f"{name}: expected {width} values, got "), F.coalesce(F.to_json(name), F.lit("none")))
        rows = rows.withColumn(name, F.when(F.coalesce(sound, F.lit(False)), F.col(name)).otherwise(F.raise_error(told)))
    return rows.withColumn("searchDepth", F.coalesce("searchDepth", F.lit(0)))


def read_samples(spark: SparkSession, manifest: str, label_key: str, prefer_packed: bool = True) -> SampleSet:
    """The samples that ``manifest`` names, with the columns of ``SAMPLE``, whichever form they have.

    A packed set beside the manifest is read in its place unless ``prefer_packed`` is false. Paths in a manifest are
    relative to its folder or absolute. Samples of a split other than ``eval`` train. Labels are those of ``label_key``,
    else ``labels``; a manifest without any, of an unknown form or that is not there is an error. Files are read by Spark;
    only the manifest itself, and the samples within one, pass through the driver.
    """
    text, path = None, manifest
    if prefer_packed and manifest.endswith(MANIFEST) and not manifest.endswith(PACKED_MANIFEST):
        path = manifest.removesuffix(MANIFEST) + PACKED_MANIFEST
        text = _text(spark, path)
    if text is None:
        path = manifest
        text = _text(spark, path)
    if text is None:
        raise FileNotFoundError(manifest)
    payload = json.loads(text)
    labels = payload.get(label_key) or payload.get("labels")
    if not labels:
        raise ValueError(f"no labels under {label_key} in {path}")
    form = payload.get("format", INLINE)
    folder = path.rpartition("/")[0]
    beside = lambda p: p if p.startswith("/") or "://" in p else f"{folder}/{p}"
    if "samples" in payload:
        whole = spark.read.schema(f"samples array<struct<{SAMPLE}, split string>>".replace(" array<int>", ":array<int>").replace(" int", ":int").replace("split string", "split:string"))
        rows = whole.json(path, multiLine=True).select(F.inline("samples"))
        held_out = F.coalesce(F.col("split") == "eval", F.lit(False))
        train, evaluation = (_checked(rows.where(c).drop("split")) for c in (~held_out, held_out))
        splits = [s.get("split") == "eval" for s in payload["samples"]]
        counts = {"train": splits.count(False), "eval": splits.count(True)}
    elif form in (LINES, PACKED):
        if form == LINES:
            train, evaluation = (_checked(spark.read.schema(SAMPLE).json(beside(payload[p]), mode="FAILFAST")) for p in ("trainPath", "evalPath"))
        else:
            shards = lambda key: spark.read.schema(SAMPLE).parquet(*map(beside, payload[key])) if payload[key] else spark.createDataFrame([], SAMPLE)
            train, evaluation = _checked(shards("trainShards")), _checked(shards("evalShards"))
        kind = "OpSamples" if label_key == "opLabels" else "ValueSamples"
        told = payload.get("sampleCounts") or {}
        counts = {split: told.get(split + kind) for split in ("train", "eval")}
    else:
        raise ValueError(f"unknown form {form} in {path}")
    metadata = {k: payload.get(k) for k in ("historyWindow", "limitPuzzles", "limitPerPuzzle", "sourceCsv", "evalPercent", "minRating", "packedFrom", "shardRows")}
    return SampleSet(train, evaluation, counts, list(labels), {"format": form, **{k: v for k, v in metadata.items() if v is not None}})


def write_packed(samples: SampleSet, manifest: str, label_key: str, shard_rows: int = 100_000) -> None:
    """Write a set as Parquet shards of at most ``shard_rows`` rows and the packed manifest beside ``manifest``."""
    spark, packed = samples.train.sparkSession, manifest.removesuffix(MANIFEST) + PACKED_MANIFEST
    folder, _, name = packed.rpartition("/")
    payload: dict = {"format": PACKED, label_key: samples.labels, "shardRows": shard_rows, "packedFrom": manifest.rpartition("/")[2], "sampleCounts": {}}
    kind = "OpSamples" if label_key == "opLabels" else "ValueSamples"
    for split, rows in (("train", samples.train), ("eval", samples.eval)):
        place = f"{name.removesuffix(PACKED_MANIFEST)}-{split}"
        rows.write.option("maxRecordsPerFile", shard_rows).mode("overwrite").parquet(f"{folder}/{place}")
        payload[f"{split}Shards"] = [place]
        payload["sampleCounts"][split + kind] = spark.read.schema(SAMPLE).parquet(f"{folder}/{place}").count()
    text = json.dumps({**samples.metadata, **payload}, indent=1)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(packed)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()
