"""Scaling of assembled feature vectors; the feature names stay attached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import MinMaxScaler, StandardScaler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.operators.columns import feature_names, name_features
from tunekit.operators.prep.base import Fitted, Prep, number, quoted


class FittedScaler(Fitted):
    """A stock scaler model; `shift` and `scale` repeat it as x -> (x - shift) * scale, or a constant for scale None."""

    def __init__(self, names, constants, model, shift: list[float], scale: list[float | None], constant: float):
        super().__init__(names, constants)
        self.model, self.shift, self.scale, self.constant = model, shift, scale, constant

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = self.model.transform(dataset)
        order = [c for c in dataset.columns if c != "features"]
        return scaled.select(*order, name_features(F.col("_scaled"), self.names))

    def cells(self, inputs: Sequence[str], place: str | None = None) -> list[str]:
        return [
            number(self.constant) if k is None else f"({quoted(c)} - {number(s)}) * {number(k)}"
            for c, s, k in zip(inputs, self.shift, self.scale)
        ]


class MinMax(Prep):
    """(x - min) / (max - min) of the training rows; a constant feature becomes 0.5.

    Other rows may leave [0, 1]: nothing is clamped.
    """

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = feature_names(df)
        model = MinMaxScaler(inputCol="features", outputCol="_scaled").fit(df)
        low, high = model.originalMin.toArray(), model.originalMax.toArray()
        constants = [(n, k, v) for n, lo, hi in zip(names, low, high) for k, v in (("min", lo), ("max", hi))]
        scale = [1.0 / float(hi - lo) if hi > lo else None for lo, hi in zip(low, high)]
        return FittedScaler(names, constants, model, [float(v) for v in low], scale, 0.5)

    def identity(self, df: DataFrame) -> Fitted:
        return Fitted(feature_names(df), [], enabled=False)


class Standardize(Prep):
    """x / sample deviation; with `with_mean` also centred.  A constant feature becomes 0."""

    def __init__(self, with_mean: bool = False, **kw):
        super().__init__(**kw)
        self.with_mean = with_mean

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = feature_names(df)
        model = StandardScaler(inputCol="features", outputCol="_scaled", withMean=self.with_mean, withStd=True).fit(df)
        constants = [
            (n, k, v) for n, m, s in zip(names, model.mean.toArray(), model.std.toArray()) for k, v in (("mean", m), ("stddev", s))
        ]
        shift = [float(m) if self.with_mean else 0.0 for m in model.mean.toArray()]
        scale = [1.0 / float(v) if v > 0 else None for v in model.std.toArray()]
        return FittedScaler(names, constants, model, shift, scale, 0.0)

    def identity(self, df: DataFrame) -> Fitted:
        return Fitted(feature_names(df), [], enabled=False)
