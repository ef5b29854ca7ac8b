"""What context-tree weighting writes and deals: values go back to chunks without joins, texts and runs compactly."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import ctw

from .test_operators import docs, none  # noqa: F401


def test_no_join_goes_back_to_the_chunks(docs):
    """Joins of all runs and words with their values took most of the disk."""
    found = ctw.score(docs, F.col("doc_id") > 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and found.count() == docs.count()


def test_words_of_one_chunk_and_of_several(spark):
    """A word that trains in one chunk alone is counted there, one of several chunks or of held-out rows by all."""
    rows = [(1, "one both"), (2, "two both both"), (3, "one two both none")]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in ctw.score(table, F.col("doc_id") < 3).collect()}
    counts, total, kinds = {"one": 1, "two": 1, "both": 3, None: 2}, 7, 4
    for i, text in rows:
        words = [*text.split(), None]
        base = sum(np.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in words)
        assert got[i] == (len(words), sum(w in counts for w in words), total, round(base, 9))


def test_turned_runs_and_packed_texts():
    rng = np.random.default_rng(1)
    for depth, head in ((5, 3), (6, 3), (2, 2), (3, 0), (0, 0)):
        keys = np.unique(rng.integers(0, 1 << (8 * depth + 8), 500))
        turned = ctw.turn(keys, depth, head)
        assert len(np.unique(turned)) == len(keys) and (turned >= 0).all()
        assert (ctw.turn_back(turned, depth, head) == keys).all()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, None], pa.int64()), "trains": [True, False], "text": ["ä\n" * 9, ""]})
    texts = pa.table({"texts": [ctw.packed(batch.slice(0, 1)), ctw.packed(batch.slice(1))]})
    assert pa.Table.from_batches(ctw.unpacked(texts)).to_pylist() == batch.to_pylist()
