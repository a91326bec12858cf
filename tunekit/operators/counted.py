"""Boosted classification trees from counted cells.

`pyspark.ml` cuts every feature at `maxBins` - 1 thresholds at most, which it finds in the rows or, of many rows, in as many
drawn ones as `_drawn` says, and then passes over all rows for every level of every tree.  Rows of one label between the same thresholds are
the same to the trees, so here they are counted in one pass and the trees are grown on the counts by the same estimator, with the count as the
weight: as many cells as the thresholds and labels allow, however many rows there are.  The trees read codes, the number of thresholds
below a value, so what is scored is coded first (`coded`, `coder`).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, prod, sqrt

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 10_000  # tables of fewer rows are fitted as they are
GAIN = 2  # rows to a cell, at least, for counting them to be worth its shuffle
PART_CELLS = 1 << 15  # cells to a task: the fit runs hundreds of jobs over them

Cuts = list[list[float]]


def countable(estimator: Estimator) -> bool:
    """Whether counts can stand for rows: nothing is drawn for each row or node, and no limit is one of rows."""
    return (
        isinstance(estimator, GBTClassifier)
        and estimator.getSubsamplingRate() == 1.0
        and estimator.getMinInstancesPerNode() == 1
        and estimator.getMinWeightFractionPerNode() == 0.0
        and estimator.getFeatureSubsetStrategy() == "all"
        and not estimator.isDefined("validationIndicatorCol")
    )


def _drawn(bins: int) -> int:
    """Rows in which `pyspark.ml` looks for thresholds."""
    return max(bins * bins, 10_000)


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> list[float]:
    """At most `most` thresholds by the rule of `pyspark.ml`: all between distinct values, or those nearest to even steps of weight."""
    distinct, place = np.unique(values, return_inverse=True)
    middle = (distinct[1:] + distinct[:-1]) / 2.0
    if len(middle) <= most:
        return middle.tolist()
    upto = np.cumsum(np.bincount(place, weights))
    step = upto[-1] / (most + 1)
    found, target = [], step
    for i, (before, after) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
        if abs(before - target) < abs(after - target):
            found.append(float(middle[i]))
            target += step
    return found


def coder(cuts: Cuts, inputs: Sequence[str], outputs: Sequence[str]) -> Bucketizer:
    """A stage that adds codes: the number of cuts below a value, so that a value at a cut is below it; NaN comes last."""
    top = np.finfo(float).max  # where there is no cut
    splits = [[-np.inf, *([float(np.nextafter(c, np.inf)) for c in own] or [float(top)]), np.inf] for own in cuts]
    return Bucketizer(splitsArray=splits, inputCols=list(inputs), outputCols=list(outputs), handleInvalid="keep")


def _with_codes(df: DataFrame, source: str, cuts: Cuts) -> DataFrame:
    """Add the components of a vector column as `_x<i>` and their codes as `_c<i>`."""
    x = [F.col("_x")[i] for i in range(len(cuts))]
    flat = df.withColumn("_x", vector_to_array(source)).withColumns({f"_x{i}": c for i, c in enumerate(x)}).drop("_x")
    return coder(cuts, [f"_x{i}" for i in range(len(x))], [f"_c{i}" for i in range(len(x))]).transform(flat)


def coded(df: DataFrame, source: str, cuts: Cuts, target: str) -> DataFrame:
    """Add the vector of the codes of a vector column."""
    codes = F.array(*[f"_c{i}" for i in range(len(cuts))])
    return _with_codes(df, source, cuts).withColumn(target, array_to_vector(codes)).drop(*[f"{k}{i}" for i in range(len(cuts)) for k in ("_x", "_c")])


def cells(rows: DataFrame, features: str, label: str, cuts: Cuts, weight: str | None = None) -> DataFrame:
    """(features: the codes, label, _n): the rows between the same thresholds with one label, counted, or their weights added up.

    A missing vector, a component that is no finite number and a weight that is missing or negative come through, for the fit to refuse.
    """
    one = F.lit(1.0) if weight is None else F.when(F.col(weight).isNull() | (F.col(weight) < 0), F.lit(float("nan"))).otherwise(F.col(weight).cast("double"))
    names = [f"_c{i}" for i in range(len(cuts))]
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    flat = _with_codes(rows.select(F.col(features).alias("features"), F.col(label).alias("label"), one.alias("_w")), "features", cuts)
    flat = flat.select("label", "_w", *[F.when(odd(F.col(f"_x{i}")), F.col(f"_x{i}")).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)])
    found = flat.groupBy("label", *names).agg(F.sum("_w").alias("_n"))
    known = F.col("_c0").isNotNull()
    return found.select(F.when(known, array_to_vector(F.array(*names))).alias("features"), "label", "_n")


def alike(rows: DataFrame, models: Sequence[tuple[Sequence[int] | None, Cuts]], keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys..., features, weight): the rows that no model tells apart counted, or their weights added up, with a vector that is coded as theirs.

    `models` has the features (None: all) and the cuts of every model; rows differ where a cut of any model lies between them.
    """
    cuts: dict[int, set[float]] = {}
    for indices, own in models:
        for place, values in zip(indices if indices is not None else range(len(own)), own):
            cuts.setdefault(place, set()).update(values)
    places = sorted(cuts)
    one = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    names = {f"_x{i}": F.col("_x")[i] for i in places}
    flat = rows.select(*keys, one.alias("_w"), vector_to_array("features").alias("_x")).withColumns(names)
    flat = coder([sorted(cuts[i]) for i in places], list(names), [f"_c{i}" for i in places]).transform(flat)
    width = max(places) + 1
    flat = flat.select(*keys, "_w", *[f"_c{i}" for i in places], *[F.col(f"_x{i}") if i in cuts else F.lit(0.0).alias(f"_x{i}") for i in range(width)])
    found = flat.groupBy(*keys, *[f"_c{i}" for i in places]).agg(F.sum("_w").alias("weight"), *[F.min(f"_x{i}").alias(f"_x{i}") for i in range(width)])
    known = F.col(f"_x{places[0]}").isNotNull()
    return found.select(*keys, F.when(known, array_to_vector(F.array(*[f"_x{i}" for i in range(width)]))).alias("features"), "weight")


def _cuts_of(rows: DataFrame, features: str, weight: str | None, bins: int, n: int, seed: int) -> Cuts:
    drawn = rows if n <= _drawn(bins) else rows.sample(False, _drawn(bins) / n, seed)
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    seen = drawn.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"), own.alias("w")).toArrow()  # about `_drawn` rows
    if not seen.num_rows:
        return []
    values = np.array(seen.column("x").combine_chunks().flatten()).reshape(seen.num_rows, -1)
    weights = seen.column("w").to_numpy()
    return [thresholds(values[:, i], weights, min(bins, n) - 1) for i in range(values.shape[1])]


def fit(estimator: Estimator, rows: DataFrame, features: str, weight: str | None = None) -> tuple[Model, Cuts, tuple[float, float]] | None:
    """(model of codes, cuts, smallest and largest margin) of a `countable` estimator, or None where counting does not make the rows fewer."""
    n = rows.count()
    if n <= LEAST_ROWS:
        return None
    bins, label = estimator.getMaxBins(), estimator.getLabelCol()
    cuts = _cuts_of(rows, features, weight, bins, n, estimator.getSeed() % 2**31)
    if not cuts or not all(np.isfinite(c).all() for c in cuts) or GAIN * 2 * prod(len(c) + 1 for c in cuts) > n:
        return None
    counted = cells(rows, features, label, cuts, weight).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # with as many bins as this the fit looks at every cell for its thresholds, which are one to a code
        size = counted.count()
        wide = max(bins, ceil(sqrt(size)) + 1)
        own = estimator.copy().setFeaturesCol("features").setLabelCol("label").setWeightCol("_n").setMaxBins(wide)
        model = own.fit(counted.coalesce(max(1, ceil(size / PART_CELLS))))
        margin = F.element_at(vector_to_array("rawPrediction"), 2)
        reach = model.transform(counted).agg(F.min(margin), F.max(margin)).first()
    finally:
        counted.unpersist()
    return model, cuts, (reach[0], reach[1])
