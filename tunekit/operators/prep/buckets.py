"""Quantile buckets: an added rank column per feature."""

from __future__ import annotations

import math

from pyspark.ml import Transformer
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame

from tunekit.operators.columns import quantiles
from tunekit.operators.prep.base import Fitted, Prep


class FittedBuckets(Fitted):
    def __init__(self, names, constants, inputs: list[str], splits: list[list[float]]):
        super().__init__(names, constants)
        self.stage = Bucketizer(
            splitsArray=splits, inputCols=inputs, outputCols=[f"{c}_rank" for c in inputs], handleInvalid="keep"
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.stage.transform(dataset)

    def stages(self) -> list[Transformer]:
        return [self.stage]


class QuantileBuckets(Prep):
    """Add `<feature>_rank` in 0..n-1 for every feature and keep the feature itself.

    The outer buckets are open-ended, equal quantiles merge, missing values get a bucket of their own.  The error of the
    quantiles is `rel_error` at most and a tenth of a bucket at most; 0 means exact ones.
    """

    def __init__(self, buckets: int = 2, rel_error: float = 0.001, **kw):
        super().__init__(**kw)
        if buckets < 2:
            raise ValueError("need at least two buckets")
        self.buckets = int(buckets)
        self.rel_error = min(rel_error, 0.1 / self.buckets)

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = self.inputs(df)
        points = [i / self.buckets for i in range(1, self.buckets)]
        cuts = {
            c: sorted({0.0 if v == 0 else v for v in qs if v is not None})
            for c, qs in quantiles(df, names, points, self.rel_error).items()
        }
        splits = [[-math.inf, *cuts[c], math.inf] if cuts[c] else [-math.inf, 0.0, math.inf] for c in names]
        constants = [(c, f"split_{i}", v) for c in names for i, v in enumerate(cuts[c])]
        return FittedBuckets(names + [f"{c}_rank" for c in names], constants, names, splits)
