"""The search space: parameters with bounds, start point and pace, and rules on parameter vectors.

A space describes one chain, so it is a few dozen rows at most: it is inlined as literal arrays and every rule
below is a projection of the `params` array, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.functions import arrays
from tunekit.functions.arrays import lit_array, running_total
from tunekit.functions.draws import normal

DOUBLE, INT, BOOLEAN = 1, 2, 3  # fixed values: parameter kinds

TABLE_SCHEMA = "param_idx int, op_idx int, name string, kind int, low double, high double, start double, pace double"


@dataclass(frozen=True)
class Param:
    """One hyper-parameter.  `needs=(name, least)`: falls to its lower bound while that parameter is below `least`."""

    name: str
    start: float
    low: float
    high: float
    pace: float
    kind: int = DOUBLE
    needs: tuple[str, float] | None = None


@dataclass(frozen=True)
class Space:
    """The parameters of a chain, one tuple of parameters per operator."""

    ops: tuple[tuple[Param, ...], ...]
    op_names: tuple[str, ...] = field(default=())

    @property
    def params(self) -> list[Param]:
        return [p for op in self.ops for p in op]

    def __len__(self) -> int:
        return len(self.params)

    def array(self, attr: str) -> Column:
        return lit_array([getattr(p, attr) for p in self.params])

    def index(self, name: str) -> int:
        return [p.name for p in self.params].index(name)

    def table(self, spark: SparkSession) -> DataFrame:
        rows, at = [], 0
        for op_idx, op in enumerate(self.ops):
            for p in op:
                rows.append((at, op_idx, p.name, p.kind, float(p.low), float(p.high), float(p.start), float(p.pace)))
                at += 1
        return spark.createDataFrame(rows, TABLE_SCHEMA)

    def each(self, params: Column, rule: Callable[[Column, Column], Column]) -> Column:
        """Apply `rule(value, spec)` to each parameter, spec = struct(i, low, high, start, pace, kind)."""
        specs = [
            F.struct(
                F.lit(i).alias("i"),
                F.lit(float(p.low)).alias("low"),
                F.lit(float(p.high)).alias("high"),
                F.lit(float(p.start)).alias("start"),
                F.lit(float(p.pace)).alias("pace"),
                F.lit(p.kind).alias("kind"),
            )
            for i, p in enumerate(self.params)
        ]
        return F.zip_with(params, F.array(*specs), rule)

    def clamp_round(self, params: Column) -> Column:
        """Clamp to the bounds; inside them INT and BOOLEAN are rounded half up."""

        def rule(x: Column, s: Column) -> Column:
            inside = F.when(s["kind"] == DOUBLE, x).otherwise(F.floor(x + 0.5).cast("double"))
            return F.when(x >= s["high"], s["high"]).when(x <= s["low"], s["low"]).otherwise(inside)

        return self.each(params, rule)

    def switch_off(self, params: Column) -> Column:
        """Parameters whose `needs` is not met become 0 and then their lower bound."""
        cells = []
        for i, p in enumerate(self.params):
            x = F.element_at(params, i + 1)
            if p.needs is not None:
                gate = F.element_at(params, self.index(p.needs[0]) + 1)
                off = min(max(0.0, float(p.low)), float(p.high))
                x = F.when(gate < F.lit(float(p.needs[1])), F.lit(off)).otherwise(x)
            cells.append(x)
        return F.array(*cells)

    def format(self, params: Column) -> Column:
        """The vector a chain can run: clamped, rounded, switched-off operators reset."""
        fitted = self.clamp_round(params)
        return arrays.let(fitted, self.switch_off) if any(p.needs for p in self.params) else fitted

    def initial(self, studies: DataFrame, n: int, salt: str = "init", key: str = "study_id") -> DataFrame:
        """(study, slot, params): n start vectors per study, start + pace * normal draw, formatted."""
        slots = studies.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
        draws = [
            F.lit(float(p.start)) + F.lit(float(p.pace)) * normal([key, "slot"], f"{salt}/{i}") for i, p in enumerate(self.params)
        ]
        raw = slots.select(key, "slot", F.array(*draws).alias("raw"))
        return raw.select(key, "slot", self.format(F.col("raw")).alias("params"))

    def op_of(self, param_idx: Column) -> Column:
        """Index of the operator that owns a parameter index."""
        ends = running_total(lit_array([len(op) for op in self.ops]))
        return F.size(F.filter(ends, lambda e: e <= param_idx))

    def first_of(self, op_idx: Column) -> Column:
        """First parameter index of an operator."""
        starts = [sum(len(o) for o in self.ops[:i]) for i in range(len(self.ops))]
        return F.element_at(F.array(*[F.lit(s) for s in starts]), op_idx + 1)

    def last_of(self, op_idx: Column) -> Column:
        """Last parameter index of an operator."""
        ends = [sum(len(o) for o in self.ops[: i + 1]) - 1 for i in range(len(self.ops))]
        return F.element_at(F.array(*[F.lit(e) for e in ends]), op_idx + 1)


def switch(op: str) -> Param:
    return Param(f"{op}.on", 1.0, 0.0, 1.0, 0.5, BOOLEAN)


def _gated(op: str, name: str, start, low, high, pace, kind=DOUBLE) -> Param:
    return Param(f"{op}.{name}", start, low, high, pace, kind, needs=(f"{op}.on", 1.0))


#: Parameters of registered operators that are not stock: name to a function of the number of features and rows.
OWN_PARAMS: dict[str, Callable[[int, float], Sequence[Param]]] = {}


def op_params(op: str, n_features: int = 1, n_rows: float = 1e5) -> tuple[Param, ...]:
    """Parameters of an operator by its chain name; bounds that depend on the data take its sizes."""
    if op in OWN_PARAMS:
        return tuple(OWN_PARAMS[op](n_features, n_rows))
    # Fixed values from here on: start, bounds and pace of the stock parameters.
    if op in ("minmax", "standardize"):
        return (switch(op),)
    if op == "fill":
        return (Param("fill.median", 0.0, 0.0, 1.0, 0.5, BOOLEAN),)
    if op == "clip":
        return (switch(op), _gated(op, "method", 1.0, 0.0, 14.0, 1.0, INT))
    if op == "power":
        return (switch(op), _gated(op, "code", 8.0, 0.0, 17.0 * n_features - 1.0, 1.0, INT))
    if op == "buckets":
        return (switch(op), _gated(op, "count", 2.0, 2.0, 1e5, 1.0, INT))
    if op == "rbf":
        return (
            switch(op),
            _gated(op, "k", 10.0, 2.0, float(n_rows), 1.0, INT),
            _gated(op, "iters", 20.0, 1.0, 1000.0, 1.0, INT),
            _gated(op, "ratio", 0.2, 0.01, 10.0, 0.01),
        )
    if op == "lasso":
        return (Param("lasso.lambda", 1e-3, 0.0, 1.0, 1e-6),)
    if op == "lr":
        return (Param("lr.lambda", 0.2, 0.0, 100.0, 0.01),)
    if op == "rf":
        return (
            Param("rf.subset", 0.0, 0.0, 5.0, 1.0, INT),
            Param("rf.ratio", 0.0, 0.05, 1.0, 0.05, DOUBLE, needs=("rf.subset", 5.0)),
            Param("rf.gini", 1.0, 0.0, 1.0, 0.5, BOOLEAN),
            Param("rf.bins", 32.0, 2.0, 1024.0, 1.0, INT),
            Param("rf.depth", 5.0, 1.0, 10.0, 1.0, INT),
            Param("rf.min_rows", 1.0, 1.0, 30.0, 1.0, INT),
            Param("rf.trees", 20.0, 1.0, 200.0, 1.0, INT),
            Param("rf.sample", 1.0, 0.5, 1.0, 0.02),
        )
    if op == "gbt":
        return (
            Param("gbt.iters", 20.0, 1.0, 100.0, 1.0, INT),
            Param("gbt.bins", 32.0, 2.0, 1024.0, 1.0, INT),
            Param("gbt.depth", 5.0, 1.0, 10.0, 1.0, INT),
            Param("gbt.min_rows", 1.0, 1.0, 30.0, 1.0, INT),
            Param("gbt.step", 0.1, 1e-4, 1.0, 1e-4),
            Param("gbt.sample", 1.0, 0.5, 1.0, 0.02),
        )
    return ()  # steps, greedy and the validations have none


def chain_space(ops: Sequence[str], n_features: int = 1, n_rows: float = 1e5) -> Space:
    return Space(tuple(op_params(op, n_features, n_rows) for op in ops), tuple(ops))
