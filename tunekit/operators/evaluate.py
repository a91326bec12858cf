"""Scores of a training table's features: correlation, entropy, information gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.operators.columns import present


def correlations(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, corr with the label) for all features in one pass; null for a constant feature."""
    flat = df.agg(*[F.corr(present(c), F.col(label)).alias(c) for c in features])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features]
    return flat.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _plogp(part: Column, whole: Column) -> Column:
    share = part / whole
    return F.when(part > 0, share * F.log2(share)).otherwise(F.lit(0.0))


def _bucket_counts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, bucket, n, p): rows and positives per bucket, combined before the one shuffle."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bucket")) for c in features]
    long = df.select(F.explode(F.array(*cells)).alias("r"), F.col(label).alias("y")).select("r.*", "y")
    return long.groupBy("feature", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("p"))


def bucket_scores(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, entropy, info_gain) of bucketed features, in bits.

    H(bucket) = log2 N - sum(n log2 n) / N, so the counts are added up once, without a join with their total.
    """
    n, p = F.col("n"), F.col("p")
    inner = -(_plogp(p, n) + _plogp(n - p, n))  # label entropy inside one bucket
    sums = _bucket_counts(df, features, label).groupBy("feature").agg(
        F.sum(n).alias("tn"), F.sum(p).alias("tp"), F.sum(n * F.log2(n)).alias("nlogn"), F.sum(n * inner).alias("inside")
    )
    tn, tp = F.col("tn"), F.col("tp")
    entropy_all = F.log2(tn) - F.col("nlogn") / tn
    label_all = -(_plogp(tp, tn) + _plogp(tn - tp, tn))
    return sums.select("feature", entropy_all.alias("entropy"), (label_all - F.col("inside") / tn).alias("info_gain"))


def entropy(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, entropy in bits) of bucketed features."""
    return bucket_scores(df, features, label).select("feature", "entropy")
