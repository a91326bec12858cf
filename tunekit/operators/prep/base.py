"""The contract of a transform: fit, apply, report the constants, save.

`Prep` is a `pyspark.ml` estimator and `Fitted` its model, so both also work inside a `Pipeline`.  A fitted
transform is a projection with its constants inlined; `stages()` gives it as stock `pyspark.ml` stages that
can be saved, `stats()` as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS_SCHEMA = "feature string, key string, value double"


def number(value: float) -> str:
    """A double as SQL text that reads back as the same double."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Fitted(Model):
    """A fitted transform: feature names after it, its constants, and how to apply and to save it."""

    def __init__(self, names: Sequence[str], constants: Sequence[tuple[str, str, float]], enabled: bool = True):
        super().__init__()
        self.names = list(names)
        self.constants = list(constants)
        self.enabled = enabled

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset

    def stages(self) -> list[Transformer]:
        """Stock stages with the same effect on a wide table, for saving."""
        return []

    def cells(self, inputs: Sequence[str], place: str | None = None) -> list[str]:
        """For transforms of vectors: the new features as SQL over the columns that hold the old ones.

        With `place` they may read the column of that name, which holds the value of `prelude`.
        """
        return list(inputs)

    def prelude(self, inputs: Sequence[str]) -> str | None:
        """For transforms of vectors: SQL of a value that `cells` can share, or None."""
        return None

    def stats(self, spark: SparkSession) -> DataFrame:
        """Fitted constants as (feature, key, value)."""
        return spark.createDataFrame([(f, k, float(v)) for f, k, v in self.constants], STATS_SCHEMA)


class FittedColumns(Fitted):
    """A transform of wide tables: replaced columns, added columns, dropped columns, as SQL expressions."""

    def __init__(self, names, constants, replaced=None, added=None, dropped=(), enabled=True):
        super().__init__(names, constants, enabled)
        self.replaced: dict[str, str] = dict(replaced or {})
        self.added: dict[str, str] = dict(added or {})
        self.dropped = set(dropped)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = [
            F.expr(self.replaced[c]).alias(c) if c in self.replaced else F.col(quoted(c))
            for c in dataset.columns
            if c not in self.dropped
        ]
        return dataset.select(*kept, *[F.expr(e).alias(c) for c, e in self.added.items()])

    def stages(self) -> list[Transformer]:
        # EXCEPT makes the statements independent of which other columns the table has
        out: list[Transformer] = []
        if self.added:
            cells = ", ".join(f"{e} AS {quoted(c)}" for c, e in self.added.items())
            out.append(SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__"))
        if self.replaced:
            cells = ", ".join(f"{e} AS {quoted(c)}" for c, e in self.replaced.items())
            gone = ", ".join(quoted(c) for c in self.replaced)
            out.append(SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {cells} FROM __THIS__"))
        if self.dropped:
            gone = ", ".join(quoted(c) for c in sorted(self.dropped))
            out.append(SQLTransformer(statement=f"SELECT * EXCEPT ({gone}) FROM __THIS__"))
        return out


class Prep(Estimator):
    """Base of the transforms.  With `enabled=False` it fits to the identity."""

    def __init__(self, features: Sequence[str] | None = None, enabled: bool = True, label: str = "label", keep: Sequence[str] = ()):
        super().__init__()
        self.features = list(features) if features is not None else None
        self.enabled = enabled
        self.label = label
        self.keep = list(keep)

    def inputs(self, df: DataFrame) -> list[str]:
        if self.features is not None:
            return self.features
        return [c for c in df.columns if c != self.label and c not in self.keep]

    def identity(self, df: DataFrame) -> Fitted:
        return Fitted(self.inputs(df), [], enabled=False)

    def _fit(self, dataset: DataFrame) -> Fitted:
        return self.fit_rows(dataset) if self.enabled else self.identity(dataset)

    def fit_rows(self, df: DataFrame) -> Fitted:
        raise NotImplementedError


def columns(names: Sequence[str], expression: Callable[[str], str]) -> dict[str, str]:
    """One SQL expression per column."""
    return {c: expression(c) for c in names}
