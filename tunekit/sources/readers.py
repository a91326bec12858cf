"""Readers for training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line.  Without a schema the types are inferred, which reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def as_training_table(
    df: DataFrame, label: str = "label", features: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Cast the features and the label to double once; `keep` columns (row keys) pass through unchanged.

    Without `features`, all columns but the label and `keep` count as features.  Rows without a label are left out.
    """
    if label not in df.columns:
        raise ValueError(f"no column '{label}' to use as the label")
    features = list(features) if features is not None else [c for c in df.columns if c != label and c not in keep]
    doubles = [F.col(c).cast("double").alias(c) for c in features]
    rows = df.select(*keep, *doubles, F.col(label).cast("double").alias("label"))
    return rows.where(F.col("label").isNotNull() & ~F.isnan("label"))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """`df` in `partitions` parts, or as it is without a number.

    For files whose row groups are too few for the cores that passes over the data should use; the caller knows.
    """
    return df if partitions is None else df.repartition(partitions)
