"""Power or log transform of one feature."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tunekit.operators.prep.base import Fitted, FittedColumns, Prep, number, quoted

EXPONENTS = 17  # -4, -3.5, ..., 4
LOG_INDEX = EXPONENTS // 2


class Power(Prep):
    """Replace a feature x by `<x>_boxcox_<i>` = x ^ (0.5 (i - 8)), or by log(1 + x) for i = 8.

    `code` numbers all (feature, exponent) pairs: feature = code div 17, exponent index = code mod 17.
    A search parameter picks one pair by this code.  The log of a value <= 0 is 0.
    """

    def __init__(self, code: int | None = None, feature: str | None = None, exponent: int = LOG_INDEX, **kw):
        super().__init__(**kw)
        if code is None and feature is None:
            raise ValueError("give either a code or a feature")
        self.code = code
        self.feature = feature
        self.exponent = exponent

    def target(self, names: list[str]) -> tuple[str, int]:
        if self.code is None:
            return self.feature, self.exponent
        at = min(max(int(self.code), 0), EXPONENTS * len(names) - 1)
        return names[at // EXPONENTS], at % EXPONENTS

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = self.inputs(df)
        feature, index = self.target(names)
        x = quoted(feature)
        if index == LOG_INDEX:
            value = f"CASE WHEN {x} <= 0 THEN 0D ELSE log1p({x}) END"
        else:
            value = f"pow({x}, {number(0.5 * (index - LOG_INDEX))})"
        new = f"{feature}_boxcox_{index}"
        after = [c for c in names if c != feature] + [new]
        constants = [(feature, "exponent", 0.5 * (index - LOG_INDEX))]
        return FittedColumns(after, constants, added={new: value}, dropped=[feature])
