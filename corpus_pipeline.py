"""A training corpus from raw documents: toxicity, near-copies, secrets, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read back as the next one's
``docs``. All but the last return the columns of ``documents``; the last returns the packed pieces.

Null and empty texts are clean, one of them stays, and they are packed as an end; rows with a null id stay once; repeated
rows are copies of each other; ties are as each operator states; very long texts pass whole; an empty table gives an
empty result; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import packing, secrets, simhash, toxicity
from ledgerloom.llm import mixing as mix
from ledgerloom.llm.common import discard, materialize
from ledgerloom.llm.queries import mixing_rates, table, tokenizer_path

#: A document is toxic at this score.
TOXIC = 0.5
#: Wanted shares of tokens; toxic documents are gone by then, so there is no such domain.
MIX = {"clean_high": 0.58, "clean_low": 0.42}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.without_near_copies(docs)


def hidden_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate says."""
    return mix.repeated(docs, mixing_rates(docs, table(spark, sf_dir, "labels"), MIX))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows: ``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)``."""
    pieces = packing.tokenize(docs, tokenizer_path()).withColumn("piece", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    placed = packing.pack(pieces.drop("ids"), ["piece"]).select("piece", "sequence_id", "offset")
    return pieces.hint("merge").join(placed.hint("merge"), "piece").drop("piece")


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("secrets", hidden_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the fingerprints nor the tokens; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
