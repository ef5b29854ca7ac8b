"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step of an Arrow operator holds at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20

_local_dir: str | None = None
#: Tables of :func:`materialize` that are still there, by path.
_stored: dict[str, SparkSession] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as a cluster's machines do."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session, as in tests, gets one of its own."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_dir:
        own = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _local_dir = "file://" + own
    return _local_dir


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost one scan, and sizes are known.

    A table that no later plan reads is deleted by :func:`discard`, the others when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(_clear)
    _stored[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_ledgerloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    _stored.pop(path, None)


def _clear() -> None:
    """Delete what is left at the driver's end; without its JVM the folder's owner has to."""
    for path, spark in list(_stored.items()):
        try:
            _delete(spark, path)
        except Exception:
            return


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = 32) -> DataFrame:
    """Inner join of ``many`` with ``few``, whose ``key`` is unique, with each key's rows dealt over up to ``salts`` tasks.

    Rows are dealt by a hash of ``by``; a row of ``few`` is sent once for each salt that occurs with its key.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = dealt.select(key, "_salt").distinct().hint("merge").join(few.hint("merge"), key)
    return dealt.hint("merge").join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def steps(batches: Iterator[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``size`` bytes of the column ``text``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def map_steps(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterator[dict[str, list]]],
    schema: str,
    text: str = "text",
) -> DataFrame:
    """``mapInArrow`` in steps of bounded size; ``function`` yields columns by name for each step."""
    importable(df.sparkSession)
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, text):
            for columns in function(step):
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
