"""Assembling, slicing and one-pass statistics of feature columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.functions.arrays import quoted
from tunekit.functions.scan import exponent

_STATS = {
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
    "stddev": F.stddev_samp,
}


def present(name: str) -> Column:
    """The column with NaN turned into null, so that aggregates skip both kinds of missing value."""
    return F.nanvl(F.col(quoted(name)), F.lit(None).cast("double"))


def feature_columns(df: DataFrame, label: str = "label", keep: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != label and c not in keep]


def assemble(df: DataFrame, features: Sequence[str] | None = None, label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., features vector, label); the vector keeps the feature names in its metadata."""
    features = list(features) if features is not None else feature_columns(df, label, keep)
    stage = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return stage.transform(df).select(*keep, "features", label)


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Projection by name; at least one name is needed."""
    if not names:
        raise ValueError("no columns to select")
    return df.select(*[F.col(quoted(n)) for n in names])


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Feature names of a vector column in index order, read from the schema."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    found = sorted((a["idx"], a.get("name", str(a["idx"]))) for kind in attrs.values() for a in kind)
    return [name for _, name in found]


def feature_name_table(df: DataFrame, column: str = "features") -> DataFrame:
    """Feature names as (idx, name, n_rows): the schema's names beside the number of rows they describe."""
    pairs = [F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name")) for i, n in enumerate(feature_names(df, column))]
    return (
        df.agg(F.count(F.col(column)).alias("n_rows"))
        .select(F.explode(F.array(*pairs)).alias("f"), "n_rows")
        .select("f.idx", "f.name", "n_rows")
    )


def name_features(column: Column, names: Sequence[str], alias: str = "features") -> Column:
    """Attach feature names to a vector column (scalers and expressions lose them)."""
    attrs = [{"idx": i, "name": n} for i, n in enumerate(names)]
    return column.alias(alias, metadata={"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(attrs)}})


def slice_features(df: DataFrame, names: Sequence[str], column: str = "features") -> DataFrame:
    """Keep the named features of a vector column; the other columns stay."""
    if not names:
        raise ValueError("cannot select an empty list of features")
    known = feature_names(df, column)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    cut = VectorSlicer(inputCol=column, outputCol="_slice", indices=[known.index(n) for n in names]).transform(df)
    return cut.select(*[name_features(F.col("_slice"), names, column) if c == column else F.col(c) for c in df.columns])


def quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float], rel_error: float = 0.01
) -> dict[str, list[float]]:
    """Quantiles of all columns together, missing values left out.

    With `rel_error` > 0 one pass with a sketch of bounded size per column.  With 0 the exact
    `percentile_disc` values, see `exact_quantiles`.
    """
    if rel_error <= 0:
        return exact_quantiles(df, features, probabilities)
    accuracy = max(int(round(1.0 / rel_error)), 1)
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    row = df.agg(*[F.percentile_approx(present(c), points, accuracy).alias(c) for c in features]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in features}


def exact_quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float], bins: int = 65536
) -> dict[str, list[float]]:
    """Exact quantiles (smallest value whose cumulative count reaches p * n) by narrowing histograms.

    The first pass counts values by sign and binary exponent, each further one by `bins` equal-width bins inside the
    current value range of every open target, and keeps the bin that holds the wanted rank, until its smallest and largest
    value agree.  Inside one exponent there are 2^52 values, so five passes suffice, whatever outliers and infinities
    the column holds.  No task holds more than `bins` counters per range and one bin per target reaches the driver.
    The feature columns are cached (spilling to disk) for the passes.
    """
    narrow = df.select(*[present(c).alias(c) for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _narrowed(narrow, list(features), list(probabilities), bins)
    finally:
        narrow.unpersist()


def _narrowed(df: DataFrame, features: list[str], probabilities: list[float], bins: int) -> dict[str, list[float]]:
    head = df.agg(
        *[f(c).alias(f"{i}|{n}") for i, c in enumerate(features) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    found: dict[tuple[int, int], float | None] = {}
    targets: dict[tuple[int, int], tuple[float, float, int]] = {}  # (low, high, rank inside) of open targets
    for i in range(len(features)):
        n, lo, hi = head[f"{i}|n"], head[f"{i}|lo"], head[f"{i}|hi"]
        for j, p in enumerate(probabilities):
            if n == 0:
                found[i, j] = None
            else:
                targets[i, j] = (lo, hi, min(max(math.ceil(p * n), 1), n))
    whole = True
    while True:
        found.update({t: lo for t, (lo, hi, _) in targets.items() if lo == hi})
        targets = {t: v for t, v in targets.items() if t not in found}
        if not targets:
            return {c: [found[i, j] for j in range(len(probabilities))] for i, c in enumerate(features)}
        ranges = sorted({(t[0], lo, hi) for t, (lo, hi, _) in targets.items()})
        cells = []
        for r, (i, lo, hi) in enumerate(ranges):
            x = F.col(features[i])
            if whole:
                place = exponent(x)
            else:
                place = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
            cell = F.struct(F.lit(r).alias("r"), place.cast("int").alias("bin"), x.alias("x"))
            cells.append(F.when(x.between(F.lit(lo), F.lit(hi)), cell))
        hist = (
            df.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
            .groupBy("s.r", "s.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi"))
        )
        whole = False
        upto = F.sum("n").over(Window.partitionBy("r").orderBy("bin"))
        order = list(targets)
        picks = []
        for k, t in enumerate(order):
            lo, hi, rank = targets[t]
            here = (F.col("r") == ranges.index((t[0], lo, hi))) & (F.col("upto") >= rank)
            picks.append(F.min(F.when(here, F.struct("upto", "n", "lo", "hi"))).alias(f"t{k}"))
        row = hist.withColumn("upto", upto).agg(*picks).first()
        for k, t in enumerate(order):
            bin_ = row[f"t{k}"]
            targets[t] = (bin_["lo"], bin_["hi"], targets[t][2] - (bin_["upto"] - bin_["n"]))


def median(df: DataFrame, features: Sequence[str], rel_error: float = 0.01) -> dict[str, float]:
    return {c: q[0] for c, q in quantiles(df, features, [0.5], rel_error).items()}


def statistic(df: DataFrame, features: Sequence[str], op: str) -> DataFrame:
    """One row with one statistic per column: avg, max, min, sum, count or stddev."""
    return df.agg(*[_STATS[op](present(c)).alias(c) for c in features])


def statistics_long(df: DataFrame, features: Sequence[str], ops: Sequence[str] = ("avg", "max", "min", "sum", "count")) -> DataFrame:
    """(feature, one column per statistic), computed in one pass over the data."""
    flat = df.agg(*[_STATS[op](present(c)).cast("double").alias(f"{c}|{op}") for c in features for op in ops])
    rows = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{op}`").alias(op) for op in ops]) for c in features
    ]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def array_mean(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per array position: (keys..., pos, mean)."""
    return (
        df.select(*keys, F.posexplode(column).alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(F.avg("x").alias("mean"))
    )


def trial_vectors(trials: DataFrame) -> DataFrame:
    """Trial log as (study_id, trial_id, features vector, label)."""
    return trials.select(
        "study_id", "trial_id", array_to_vector(F.col("params")).alias("features"), F.col("objective").cast("double").alias("label")
    )
