"""Mixing sources to target weights, with soft membership, in SQL functions alone.

A naive Bayes classifier over hashed words is fitted on the labelled table and gives
each document's posterior over domains; the log odds are divided by the square root
of the number of words, which keeps long documents from certainty. Every document
then gets a nonnegative rate r, fitted to

    sum_d ((sum_i n_i p_id r_i - target_d) / T)^2 / 2 + ridge / 2 * sum_i n_i / T (r_i - 1)^2

with n_i its tokens, T their sum and target_d the wanted tokens of domain d. At the
optimum r_i = max(0, 1 - sum_d p_id g_d / ridge) with g the gaps of the few domains,
so the fit is a Newton search for g: a step needs one aggregate and stores and
shuffles no rows. What is left of the gaps goes down with ridge, which only has to
keep rates apart where the targets do not.

Null and empty texts have no tokens, the prior as posterior, and a rate that no target
depends on. Labelled rows whose id or label is null are not used; an id with several
domains counts for each. Without labels posteriors are even. Null ids are kept,
repeated rows are rated each, rows of one posterior get one rate, very long texts are
counted whole, an empty table gives an empty result, and other columns are not read,
whatever their names.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Hash buckets of the classifier: the bound of its table.
BUCKETS = 1 << 16
WORD_BREAK = "[^\\p{L}\\p{N}]+"


def _words(docs: DataFrame, *keys: str) -> DataFrame:
    words = F.split(F.lower("text"), WORD_BREAK)
    return docs.select(*keys, F.explode_outer(words).alias("word")).select(
        *keys, F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).alias("bucket")
    )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], smooth: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """Word weights ``(bucket, w_<i>)``, at most ``BUCKETS`` rows, and the prior; ``labels(doc_id, domain)``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct()
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    prior = {d: (sizes.get(d, 0) + 1) / (total + len(domains)) for d in domains}
    texts = _rows(docs).where("doc_id IS NOT NULL").hint("merge").join(known.hint("merge"), "doc_id")
    counts = _words(texts, "domain").where("bucket IS NOT NULL").groupBy("bucket").agg(
        *[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)]
    )
    counts = materialize(counts, "word-counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(domains))]).first()
    share = [F.log((F.col(f"c{i}") + F.lit(smooth)) / F.lit(sums[i] + smooth * BUCKETS)) for i in range(len(domains))]
    return counts.select("bucket", *[s.alias(f"w{i}") for i, s in enumerate(share)]), prior


def posteriors(docs: DataFrame, weights: DataFrame, prior: dict[str, float], sharpness: float = 1.0) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>...)`` for each row of ``docs(doc_id, text)``."""
    domains = list(prior)
    numbered = _rows(docs).withColumn("row", F.monotonically_increasing_id())
    rated = _words(numbered, "row", "doc_id").join(F.broadcast(weights), "bucket", "left")
    sums = rated.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_tokens"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(domains))])
    scale = F.lit(sharpness) / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    odds = [F.lit(prior[d]).cast("double") for d in domains]
    logits = [F.log(o) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * scale for i, o in enumerate(odds)]
    most = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = sums.select("doc_id", "n_tokens", *[F.exp(x - most).alias(f"e{i}") for i, x in enumerate(logits)])
    total = sum((F.col(f"e{i}") for i in range(1, len(domains))), F.col("e0"))
    return powers.select("doc_id", "n_tokens", *[F.round(F.col(f"e{i}") / total, 6).alias(f"p_{d}") for i, d in enumerate(domains)])


def rates(members: DataFrame, targets: dict[str, float], ridge: float = 1e-5, most_steps: int = 40, close: float = 1e-4) -> DataFrame:
    """Add ``rate`` to a stored table of :func:`posteriors`; ``targets`` are shares of its tokens, of any sum above 0.

    The fit ends when its gaps are right to ``close`` of each target; the shares reached are logged, as a warning where
    one is off its target by more than a hundredth of it, as with targets that no rates meet.
    """
    n = F.col("n_tokens").cast("double")
    p = [F.col(f"p_{d}").cast("double") for d in targets]
    want = np.array([targets[d] / sum(targets.values()) for d in targets])
    k, tight = len(p), close * np.where(want > 0, want, 1)
    total = float(members.agg(F.coalesce(F.sum(n), F.lit(0.0))).first()[0])
    gaps = np.zeros(k)

    def at(gaps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Value, slope and curvature of the dual fit, and the shares reached."""
        rated = members.withColumn("_rate", _rate(p, gaps, ridge))
        used = F.when(F.col("_rate") > 0, n).otherwise(0.0)
        sums = rated.agg(
            F.sum(n * F.col("_rate") * F.col("_rate")), *[F.sum(n * F.col("_rate") * x) for x in p], *[F.sum(used * p[i] * p[j]) for i in range(k) for j in range(k)]
        ).first()
        found = np.array(sums, float) / total
        met = found[1 : k + 1]
        return gaps @ gaps / 2 + want @ gaps + ridge / 2 * found[0], gaps + want - met, np.eye(k) + found[k + 1 :].reshape(k, k) / ridge, met

    if total:
        value, slope, curve, met = at(gaps)
        steps, part = 1, 1.0
        while steps < most_steps and (np.abs(slope) > tight).any():
            move = -np.linalg.solve(curve, slope)
            tried = at(gaps + part * move)
            steps += 1
            if tried[0] > value + 1e-4 * part * (slope @ move) + 1e-14:
                part /= 2
                continue
            gaps, part = gaps + part * move, 1.0
            value, slope, curve, met = tried
        far = (np.abs(met - want) > 0.01 * want + 1e-6).any()
        told = ", ".join(f"{d} {m:.4f} for {w:.4f}" for d, m, w in zip(targets, met, want))
        logging.getLogger(__name__).log(logging.WARNING if far else logging.INFO, "shares after %d steps: %s", steps, told)
    return members.withColumn("rate", F.round(_rate(p, gaps, ridge), 6))


def _rate(p: list[Column], gaps: np.ndarray, ridge: float) -> Column:
    """Rate at the given gaps, which are one constant: all steps share compiled code."""
    pulls = F.array(*[F.lit(float(g / ridge)) for g in gaps])
    pull = F.aggregate(F.zip_with(F.array(*p), pulls, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.greatest(F.lit(0.0), 1 - pull)


def repeated(docs: DataFrame, rated: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as its id's rate says: the whole part, and once more with the rest's chance.

    The chance is a hash of the id, so runs agree. Rows of an id share its mean rate; null ids stay once.
    """
    own, rate, times = (fresh(docs, n) for n in ("_id", "_rate", "_times"))
    rates = rated.groupBy(F.col("doc_id").alias(own)).agg(F.avg("rate").alias(rate))
    joined = docs.hint("merge").join(rates.hint("merge"), docs["doc_id"] == F.col(own), "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = F.coalesce(F.floor(F.col(rate) + draw).cast("int"), F.lit(1))
    again = joined.withColumn(times, wanted).where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return again.select(*[docs[c] for c in docs.columns])
