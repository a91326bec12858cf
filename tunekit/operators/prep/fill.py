"""Filling missing values (null or NaN) with the mean or the median of the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.operators.columns import median, present
from tunekit.operators.prep.base import Fitted, FittedColumns, Prep, columns, number, quoted


class Fill(Prep):
    def __init__(self, method: str = "mean", rel_error: float = 0.01, **kw):
        super().__init__(**kw)
        if method not in ("mean", "median"):
            raise ValueError(f"method must be 'mean' or 'median', not {method!r}")
        self.method = method
        self.rel_error = rel_error

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = self.inputs(df)
        if self.method == "mean":
            row = df.agg(*[F.avg(present(c)).alias(c) for c in names]).first()
            values = {c: row[c] for c in names}
        else:
            values = median(df, names, self.rel_error)
        values = {c: v for c, v in values.items() if v is not None}  # nothing to fill an empty column with
        fill = columns(list(values), lambda c: f"coalesce(nanvl({quoted(c)}, NULL), {number(values[c])})")
        return FittedColumns(names, [(c, self.method, v) for c, v in values.items()], replaced=fill)
