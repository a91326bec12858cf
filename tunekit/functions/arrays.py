"""Vector arithmetic on `array<double>` columns (higher-order functions, no UDF)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name that may hold dots, as one identifier."""
    return "`" + name.replace("`", "``") + "`"


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def weighted_norm(a: Column, w: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, w, lambda x, y: x * y * x * y)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def weighted_distance(a: Column, b: Column, w: Column) -> Column:
    moved = F.zip_with(a, b, lambda x, y: x - y)
    return weighted_norm(moved, w)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / F.lit(2.0))


def running_total(xs: Column) -> Column:
    """Running sums of a short array."""
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x))
    return F.aggregate(xs, F.array().cast("array<double>"), step)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often and inside whichever lambda it is used.

    An expression that stands inside a lambda would otherwise be computed again for each array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed once per row; the optimizer does not push them into the lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def roulette_index(weights: Column, u: Column) -> Column:
    """0-based index of the first running weight that reaches `u` times the whole; null when all are 0.

    For bounded arrays (a best set, the list of strategies, the parameters of one chain); for a
    weight table of any length use `operators.propose.roulette_pick`.
    """
    start = F.struct(
        F.lit(0.0).alias("run"), F.lit(None).cast("int").alias("hit"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("i")
    )

    def spin(ws: Column, goal: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            run = acc["run"] + w
            hit = F.when(acc["hit"].isNull() & (w > 0) & (run >= goal), acc["i"]).otherwise(acc["hit"])
            last = F.when(w > 0, acc["i"]).otherwise(acc["last"])
            return F.struct(run.alias("run"), hit.alias("hit"), last.alias("last"), (acc["i"] + 1).alias("i"))

        # rounding may leave the last running sum a hair under the goal: then the last slice wins
        return F.aggregate(ws, start, step, lambda acc: F.coalesce(acc["hit"], acc["last"]))

    return let(weights, lambda ws: let(u * total(ws), lambda goal: spin(ws, goal)))
