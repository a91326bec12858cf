"""Clamping outliers into a band around the centre of the training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.operators.columns import median, present, quantiles
from tunekit.operators.prep.base import Fitted, FittedColumns, Prep, columns, number, quoted

# The band choices of the search space, in the order of their one-hot flags.
CLIP_METHODS: list[tuple[str, float]] = [
    ("mean", 2.0),
    ("mean", 2.5),
    ("mean", 3.0),
    ("mean", 3.5),
    ("median", 2.0),
    ("median", 2.5),
    ("median", 3.0),
    ("median", 3.5),
    ("tukey", 1.0),
    ("tukey", 1.5),
    ("tukey", 2.0),
    ("tukey", 2.5),
    ("tukey", 3.0),
    ("tukey", 3.5),
    ("tukey", 4.0),
]
DEFAULT_METHOD = 1


def clip_method_index(flags: Column) -> Column:
    """Index of the first flag equal to 1 in a one-hot array column; the default method when none is set."""
    at = F.array_position(flags, F.lit(1.0))
    return F.when(at > 0, at - 1).otherwise(F.lit(DEFAULT_METHOD)).cast("int")


class Clip(Prep):
    """`mean` and `median`: centre -/+ k sample deviations; `tukey`: [q1 - k IQR, q3 + k IQR]."""

    def __init__(self, method: str = "mean", k: float = 2.5, rel_error: float = 0.01, **kw):
        super().__init__(**kw)
        if method not in ("mean", "median", "tukey"):
            raise ValueError(f"unknown clip method {method!r}")
        self.method = method
        self.k = k
        self.rel_error = rel_error

    @classmethod
    def from_index(cls, index: int, **kw) -> "Clip":
        method, k = CLIP_METHODS[index]
        return cls(method, k, **kw)

    def bands(self, df: DataFrame, names: list[str]) -> tuple[dict[str, tuple[float, float]], list]:
        constants, bands = [], {}
        if self.method == "tukey":
            for c, (q1, q2, q3) in quantiles(df, names, [0.25, 0.5, 0.75], self.rel_error).items():
                if q1 is None:
                    continue
                reach = self.k * (q3 - q1)
                bands[c] = (q1 - reach, q3 + reach)
                constants += [(c, "q1", q1), (c, "median", q2), (c, "q3", q3)]
            return bands, constants
        moments = df.agg(
            *[F.avg(present(c)).alias(f"{c}|m") for c in names], *[F.stddev_samp(present(c)).alias(f"{c}|s") for c in names]
        ).first()
        if self.method == "mean":
            centre = {c: moments[f"{c}|m"] for c in names}
        else:
            centre = median(df, names, self.rel_error)
        for c in names:
            if centre[c] is None or moments[f"{c}|s"] is None:
                continue
            reach = self.k * moments[f"{c}|s"]
            bands[c] = (centre[c] - reach, centre[c] + reach)
            constants += [(c, self.method, centre[c]), (c, "stddev", moments[f"{c}|s"])]
        return bands, constants

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = self.inputs(df)
        bands, constants = self.bands(df, names)

        def clamp(c: str) -> str:
            low, high = bands[c]
            # least/greatest skip nulls and would turn a missing value into a bound
            inside = f"least(greatest({quoted(c)}, {number(low)}), {number(high)})"
            return f"CASE WHEN {quoted(c)} IS NULL OR isnan({quoted(c)}) THEN {quoted(c)} ELSE {inside} END"

        return FittedColumns(names, constants, replaced=columns(list(bands), clamp))
