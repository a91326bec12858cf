"""Running values over ordered groups of any size.

A plain window keeps a whole group in one task.  Here a group is first cut into chunks by an
order-preserving function of the order column; windows then run per chunk, over the (far fewer) chunk
totals, and per chunk again.  The cuts are quantiles of the group, written to a table before they are used, so a
recomputed task puts every row into the same chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.sources.session import through_table

CHUNK_ROWS = 65536
DIGIT_BASE = 1024
CUTS = 1000
CUT_ACCURACY = 50_000

_MERGE = {"sum": F.sum, "max": F.max}


def exponent(value: Column) -> Column:
    """An integer of bounded range that never falls as a double rises: sign and binary exponent, 0 for zero."""
    size = F.when(F.abs(value) == F.lit(float("inf")), F.lit(3000)).otherwise(F.floor(F.log2(F.abs(value))) + 1100)
    return F.when(value == 0, F.lit(0)).when(value < 0, -size).otherwise(size).cast("int")


def digits(value: Column, base: int = DIGIT_BASE) -> tuple[Column, Column]:
    """Two integers that together never fall as `value` rises.

    The first has the sign, the binary exponent and `base` parts of each power of two, the second the next sixteen bits, so
    values of any size are told apart by their leading 26 bits.
    """
    code = exponent(value)
    power = F.pow(F.lit(2.0), (F.abs(code) - 1100).cast("double"))
    share = F.when((code == 0) | (F.abs(code) == 3000), F.lit(0.0)).otherwise((F.abs(value) / power - 1.0) * F.lit(float(base)))
    first = F.floor(share)
    second = F.floor((share - first) * F.lit(65536.0))
    sign = F.signum(code.cast("double"))
    return (
        (sign * (F.abs(code) * F.lit(base) + first)).cast("int"),
        F.when(sign < 0, F.lit(65535) - second).otherwise(second).cast("int"),
    )


def with_chunks(df: DataFrame, keys: Sequence[str], order: Column, rows: int = CHUNK_ROWS, cuts: int = CUTS) -> DataFrame:
    """Add `chunk` and `chunk2`: two levels of order-preserving chunk numbers per group.

    A group is cut at quantiles of its own values into parts of about `rows` rows, `cuts` parts at most, so bursts and far
    values do not crowd a chunk, and each part of such a group again in equal widths.  Equal values
    stay together.  The quantiles are a sketch of bounded size per group; they are written down before use, so that
    a recomputed task puts every row into the same chunk.
    """
    keys = list(keys)
    df = df.withColumn("_order", order.cast("double"))
    points = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    size = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_lo"), F.max("_order").alias("_hi"),
        F.percentile_approx("_order", points, CUT_ACCURACY).alias("_cuts"),
    )
    parts = F.least(F.ceil(F.col("_n") / F.lit(float(rows))), F.lit(cuts)).cast("int")
    inner = F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1)))
    own = F.array_distinct(F.transform(inner, lambda i: F.element_at("_cuts", F.round(i * cuts / parts).cast("int"))))
    size = size.withColumn("_cuts", F.when(parts > 1, own).otherwise(F.array().cast("array<double>")))
    size = through_table(size, "cuts", merged=True)
    below = F.filter("_cuts", lambda c: c <= F.col("_order"))
    low = F.coalesce(F.try_element_at(below, F.lit(-1)), F.col("_lo"))
    high = F.coalesce(F.get("_cuts", F.size(below)), F.col("_hi"))
    unit = F.when((high > low) & (F.size("_cuts") > 0), (F.col("_order") - low) / (high - low)).otherwise(F.lit(0.0))
    fine = F.floor(F.least(unit, F.lit(1.0 - 2.0**-30)) * F.lit(float(DIGIT_BASE)))
    return (
        df.join(size, keys)
        .withColumn("chunk", F.size(below).cast("long"))
        .withColumn("chunk2", fine.cast("long"))
        .drop("_n", "_lo", "_hi", "_order", "_cuts")
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple]) -> DataFrame:
    """Running `sum` or `max` per group over a table from `with_chunks`; `<name>_all` is the whole group's value.

    `values` maps an output name to (expression, "sum" | "max") or (expression, "sum" | "max", False); with
    False the current row is left out (null on the first row of a group).  `order` must be unique in a group.
    Chunk totals are read off the windows' last rows, so that both uses of the rows share one shuffle; pass
    only the needed columns for that to hold.
    """
    keys, order = list(keys), list(order)
    part = keys + ["chunk", "chunk2"]
    merge = {name: _MERGE[v[1]] for name, v in values.items()}
    own = {name: len(v) < 3 or v[2] for name, v in values.items()}
    inside = Window.partitionBy(*part).orderBy(*order)

    def local(name: str, upto: int) -> Column:
        return merge[name](values[name][0]).over(inside.rowsBetween(Window.unboundedPreceding, upto))

    def before(name: str, cell: str, group: list[str], by: str) -> Column:
        w = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return merge[name](f"{cell}_{name}").over(w).alias(f"{cell}b_{name}")

    rows = df.select(
        *df.columns,
        *[local(n, Window.currentRow).alias(f"_l_{n}") for n in merge],
        *[local(n, -1).alias(f"_x_{n}") for n in merge if not own[n]],
    )
    fine = rows.groupBy(*part).agg(*[F.max_by(f"_l_{n}", F.struct(*order)).alias(f"_f_{n}") for n in merge])
    coarse = fine.groupBy(*keys, "chunk").agg(*[m(f"_f_{n}").alias(f"_c_{n}") for n, m in merge.items()])
    everything = Window.partitionBy(*keys)
    coarse = coarse.select(
        *keys,
        "chunk",
        *[before(n, "_c", keys, "chunk") for n in merge],
        *[m(f"_c_{n}").over(everything).alias(f"{n}_all") for n, m in merge.items()],
    )
    fine = fine.select(*part, *[before(n, "_f", keys + ["chunk"], "chunk2") for n in merge])
    out = rows.join(fine.join(coarse, keys + ["chunk"]), part)

    def joined(name: str) -> Column:
        cells = [F.col(f"_{'l' if own[name] else 'x'}_{name}"), F.col(f"_fb_{name}"), F.col(f"_cb_{name}")]
        if merge[name] is F.max:
            return F.greatest(*cells)
        filled = [F.coalesce(c, F.lit(0)) for c in cells]
        return F.when(F.coalesce(*cells).isNotNull(), filled[0] + filled[1] + filled[2])

    return out.select(*df.columns, *[joined(n).alias(n) for n in merge], *[f"{n}_all" for n in merge])


def decayed_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, decay: float) -> DataFrame:
    """(keys..., total, n): sum of value * decay ^ (rows that follow), over a table from `with_chunks`.

    Each part is summed with its own last row at weight 1 and then aged by the rows of the parts behind it.
    """
    keys = list(keys)
    level = df.select("*", value.cast("double").alias("_v"), F.lit(1).cast("long").alias("_m"))
    aged = F.lit(float(decay))
    steps = [(keys + ["chunk", "chunk2"], list(order)), (keys + ["chunk"], ["chunk2"]), (keys, ["chunk"])]
    for part, by in steps:
        behind = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in by]).rowsBetween(Window.unboundedPreceding, -1)
        rows = F.coalesce(F.sum("_m").over(behind), F.lit(0))
        level = (
            level.withColumn("_v", F.col("_v") * F.pow(aged, rows))
            .groupBy(*part)
            .agg(F.sum("_v").alias("_v"), F.sum("_m").alias("_m"))
        )
    return level.select(*keys, F.col("_v").alias("total"), F.col("_m").alias("n"))
