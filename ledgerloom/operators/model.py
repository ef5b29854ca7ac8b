"""A candidate ranker fitted and applied with Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight``: total over twice the label's count."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return rows.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn("weight", F.col("_total") / (2 * F.col("_n"))).drop("_n", "_total")


def fit_ranker(rows: DataFrame, buckets: int = 4096, rounds: int = 30) -> PipelineModel:
    """Logistic regression on the hashed words of ``context`` for ``label``, classes weighted."""
    stages = [
        Tokenizer(inputCol="context", outputCol="_words"), HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=buckets),
        LogisticRegression(featuresCol="_hashed", labelCol="label", weightCol="weight", maxIter=rounds, regParam=1e-4),
    ]
    return Pipeline(stages=stages).fit(weighted(rows, "label"))


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``model_score``, the probability of label 1."""
    out = model.transform(rows).withColumn("model_score", vector_to_array("probability")[1])
    return out.drop("_words", "_hashed", "rawPrediction", "probability", "prediction")
