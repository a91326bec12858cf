"""Repeatable splits, folds and class balancing: narrow projections and filters, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions.draws import uniform, uniform_fast


def _draw(df: DataFrame, key: Sequence[str] | None, salt: str, portable: bool) -> Column:
    if portable:
        if not key:
            raise ValueError("a portable split needs integer or string key columns")
        return uniform(key, salt)
    return uniform_fast(key or df.columns, sum(map(ord, salt)))


def ab_split(
    df: DataFrame, ratio: float = 1.0, key: Sequence[str] | None = None, salt: str = "a", portable: bool = True
) -> DataFrame:
    """Add `split`: 'A' with share ratio / (ratio + 1), else 'B'.

    The draw hashes the key (all columns when not portable and no key is given): equal rows always fall on
    the same side, so no copy of a training row is ever tested on.
    """
    share = ratio / (ratio + 1.0)
    return df.withColumn("split", F.when(_draw(df, key, salt, portable) < F.lit(share), "A").otherwise("B"))


def k_fold(
    df: DataFrame, k: int = 5, key: Sequence[str] | None = None, salt: str = "f", portable: bool = True
) -> DataFrame:
    """Add `fold` in 0..k-1."""
    return df.withColumn("fold", F.floor(_draw(df, key, salt, portable) * F.lit(float(k))).cast("int"))


def class_counts(df: DataFrame, label: str = "label") -> dict[float, int]:
    """Rows per class; raises if the label has more than two values, of which three at most come back."""
    found = df.groupBy(label).count().limit(3).collect()
    if len(found) > 2:
        raise ValueError(f"{label!r} has more than two values")
    return {r[label]: r["count"] for r in found}


def downsample(
    df: DataFrame, label: str = "label", key: Sequence[str] | None = None, salt: str = "b", portable: bool = True
) -> DataFrame:
    """Thin every class to the expected size of the smallest one."""
    counts = class_counts(df, label)
    if not counts:
        return df
    least = min(counts.values())
    keep = F.lit(None).cast("double")
    for value, n in counts.items():
        keep = F.when(F.col(label) == F.lit(value), F.lit(least / n)).otherwise(keep)
    return df.filter(_draw(df, key, salt, portable) < keep)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight` = rows / (classes * rows of the class): every class weighs the same in a fit."""
    return with_class_weights(df, class_counts(df, label), label)


def with_class_weights(df: DataFrame, counts: dict[float, int], label: str = "label") -> DataFrame:
    """Add `weight` from the rows per class of another table, such as the training side."""
    whole = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(whole / (len(counts) * n))).otherwise(weight)
    return df.withColumn("weight", weight)
