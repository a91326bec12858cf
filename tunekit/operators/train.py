"""Training: logistic regression, random forest, boosted trees, with cross-validation on a fold column.

All fold models and the final model are fitted first, a few at a time; then every row is scored by all of them in
one pass and the scores of all models are validated by one grouped job (`operators.validate`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.operators import counted, registry, validate
from tunekit.sources.session import through_table

FINAL = -1  # fold number of the model fitted on all training rows
FOLDS = 5
POSITIVE = "positive_score"  # what a saved boosted chain adds: the positive class by the margin rule

# Feature-subset strategies of the forest by code; code 5 takes a share of the features.
SUBSETS = ["auto", "all", "onethird", "sqrt", "log2"]


def logistic(lam: float = 0.2, max_iter: int = 100, elastic: float = 0.0, intercept: bool = True) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, regParam=float(lam), elasticNetParam=elastic, fitIntercept=intercept)


def forest(
    subset: float = 0,
    ratio: float = 0.05,
    gini: float = 1,
    bins: float = 32,
    depth: float = 5,
    min_rows: float = 1,
    trees: float = 20,
    sample: float = 1.0,
    seed: int = 7,
) -> RandomForestClassifier:
    code = int(subset)
    return RandomForestClassifier(
        featureSubsetStrategy=SUBSETS[code] if code < len(SUBSETS) else str(max(float(ratio), 0.05)),
        impurity="gini" if gini == 1 else "entropy",
        maxBins=int(bins),
        maxDepth=int(depth),
        minInstancesPerNode=int(min_rows),
        numTrees=int(trees),
        subsamplingRate=float(sample),
        seed=seed,
    )


def boosted(
    iters: float = 20, bins: float = 32, depth: float = 5, min_rows: float = 1, step: float = 0.1, sample: float = 1.0, seed: int = 7
) -> GBTClassifier:
    return GBTClassifier(
        maxIter=int(iters),
        maxBins=int(bins),
        maxDepth=int(depth),
        minInstancesPerNode=int(min_rows),
        stepSize=float(step),
        subsamplingRate=float(sample),
        seed=seed,
    )


TRAINERS: dict[str, Callable[..., Estimator]] = {"lr": logistic, "rf": forest, "gbt": boosted}


@dataclass
class Fit:
    """One fitted model of a trial: which fold it left out (or FINAL) and which feature indices it reads."""

    trial_id: int
    fold: int
    model: Model
    indices: list[int] | None = None
    margins: tuple[float, float] | None = None  # smallest and largest training margin of boosted trees
    cuts: counted.Cuts | None = None  # of a model that reads codes: the thresholds of its features


@dataclass
class Job:
    """A model to fit: rows `fold != fold` of the training table, or all of them."""

    trial_id: int
    fold: int
    estimator: Estimator
    indices: list[int] | None = None
    error: str | None = field(default=None)


def _rows_for(train: DataFrame, fold: int) -> DataFrame:
    return train if fold == FINAL else train.filter(F.col("fold") != fold)


def sliced(df: DataFrame, indices: Sequence[int] | None, target: str) -> DataFrame:
    if indices is None:
        return df
    return VectorSlicer(inputCol="features", outputCol=target, indices=list(indices)).transform(df)


def reason(error: Exception) -> str:
    """The message of an error; for one of the JVM its own message and that of its root cause."""
    cause = getattr(error, "java_exception", None)
    if cause is None:
        return f"{type(error).__name__}: {error}".split("\n")[0][:500]
    parts = []
    while cause is not None:
        text = str(cause.toString()).split("\n")[0]
        if text not in parts:
            parts.append(text)
        cause = cause.getCause()
    return (parts[0] if len(parts) == 1 else f"{parts[0]}; caused by {parts[-1]}")[:500]


def fit_all(train: DataFrame, jobs: Sequence[Job], parallelism: int = 4) -> list[Fit]:
    """Fit all jobs on one prepared (cached) training table, at most `parallelism` at once; a column `weight` weighs its rows.

    Boosted trees of a long table are grown on counted cells where that gives the same trees (`operators.counted`).
    A job that fails keeps its message in `error` and gives no fit; the others go on.  The caller reports it, or takes `fit_every`.
    """

    def run(job: Job) -> Fit | None:
        try:
            rows = _rows_for(train, job.fold)
            estimator = job.estimator.copy()
            if "weight" in train.columns:
                estimator.setWeightCol("weight")
            if job.indices is not None:
                rows = sliced(rows, job.indices, "_picked")
                estimator.setFeaturesCol("_picked")
            if counted.countable(estimator):
                found = counted.fit(estimator, rows, estimator.getFeaturesCol(), "weight" if "weight" in train.columns else None)
                if found is not None:
                    model, cuts, margins = found
                    return Fit(job.trial_id, job.fold, model, job.indices, margins, cuts)
            return Fit(job.trial_id, job.fold, estimator.fit(rows), job.indices)
        except Exception as e:  # noqa: BLE001 - a failed trial must not end the study
            job.error = reason(e)
            return None

    if not jobs:
        return []
    pool = ThreadPool(max(1, min(parallelism, len(jobs))))
    try:
        return [f for f in pool.map(inheritable_thread_target(train.sparkSession)(run), jobs) if f is not None]
    finally:
        pool.close()


def fit_every(train: DataFrame, jobs: Sequence[Job], parallelism: int = 4) -> list[Fit]:
    """`fit_all` for callers whose result needs every model: a job that fails ends them with its message."""
    fits = fit_all(train, jobs, parallelism)
    failed = [j.error for j in jobs if j.error]
    if failed:
        raise RuntimeError(failed[0])
    return fits


def is_boosted(model: Model) -> bool:
    return hasattr(model, "trees") and hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")


def with_outputs(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Add one array column `_o<i>` per fit: raw margins for boosted trees, probabilities for the rest.

    Slices shared by several fits are cut once.
    """
    slices: dict[tuple[int, ...], str] = {}
    for f in fits:
        if f.indices is not None and tuple(f.indices) not in slices:
            name = f"_slice{len(slices)}"
            slices[tuple(f.indices)] = name
            df = sliced(df, f.indices, name)
    for i, f in enumerate(fits):
        column = "features" if f.indices is None else slices[tuple(f.indices)]
        if f.cuts is not None:
            df, column = counted.coded(df, column, f.cuts, f"_codes{i}"), f"_codes{i}"
        model = f.model.copy().setFeaturesCol(column).setPredictionCol("")
        if is_boosted(f.model):
            model = model.setRawPredictionCol(f"_v{i}").setProbabilityCol("")
        else:
            model = model.setRawPredictionCol("").setProbabilityCol(f"_v{i}")
        df = model.transform(df).withColumn(f"_o{i}", F.element_at(vector_to_array(f"_v{i}"), 2)).drop(f"_v{i}")
    return df.drop(*slices.values(), *[f"_codes{i}" for i in range(len(fits))])


def set_margin_ranges(train: DataFrame, fits: Sequence[Fit]) -> None:
    """Fill in `margins` of all boosted fits from their own training rows, in one pass."""
    todo = [f for f in fits if is_boosted(f.model) and f.margins is None]
    if not todo:
        return
    scored = with_outputs(train, todo)
    cells = []
    for i, f in enumerate(todo):
        own = F.col(f"_o{i}") if f.fold == FINAL else F.when(F.col("fold") != f.fold, F.col(f"_o{i}"))
        cells += [F.min(own).alias(f"lo{i}"), F.max(own).alias(f"hi{i}")]
    row = scored.agg(*cells).first()
    for i, f in enumerate(todo):
        f.margins = (row[f"lo{i}"], row[f"hi{i}"])


def positive_score(fit: Fit, output: Column) -> Column:
    """Score of the positive class in [0, 1]."""
    return validate.margin_probability(output, *fit.margins) if is_boosted(fit.model) else output


def stacked_scores(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """(trial_id, fold, split, score, label): every row once per model that trained or is tested on it, with its `weight` if it has one.

    `df` holds features, label, fold and split ('A' training, 'B' test).  A fold model is trained on the other
    folds of 'A' and tested on its own; the final model is trained on 'A' and tested on 'B'.
    """
    scored = with_outputs(df, fits)
    train = F.col("split") == "A"
    cells = []
    for i, f in enumerate(fits):
        split = F.when(train, "A").otherwise("B") if f.fold == FINAL else F.when(F.col("fold") != f.fold, "A").otherwise("B")
        cell = F.struct(
            F.lit(f.trial_id).cast("long").alias("trial_id"),
            F.lit(f.fold).alias("fold"),
            split.alias("split"),
            positive_score(f, F.col(f"_o{i}")).alias("score"),
        )
        cells.append(cell if f.fold == FINAL else F.when(train, cell))
    own = ["label", *(["weight"] if "weight" in df.columns else [])]
    rows = scored.select(*own, F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
    return rows.select("s.trial_id", "s.fold", "s.split", "s.score", *own)


def _score_runs(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """The scores of `stacked_scores` as the runs that `validate.auc_of_runs` ranks.

    Where all models read codes, rows that none of them tells apart are counted first and scored as one.
    """
    if all(f.cuts is not None for f in fits):
        df = counted.alike(df, [(f.indices, f.cuts) for f in fits], ["split", "fold", "label"], "weight" if "weight" in df.columns else None)
    scored = with_outputs(df, fits)
    own = ["split", "fold", "label", *(["weight"] if "weight" in df.columns else [])]
    outputs = [f"_s{i}" for i in range(len(fits))]
    scored = scored.select(*own, *[positive_score(f, F.col(f"_o{i}")).cast("double").alias(o) for i, (f, o) in enumerate(zip(fits, outputs))])
    models = [(int(f.trial_id), int(f.fold)) for f in fits]
    return validate.wide_runs(scored, outputs, models, FINAL, weight="weight" if "weight" in df.columns else None)


def validate_fits(df: DataFrame, fits: Sequence[Fit], metrics: Sequence[str] | None = None) -> DataFrame:
    """(trial_id, fold, train_value, test_value): AUC pairs of all fits from one grouped job.

    With `metrics` (trial_id, fold, metric, train_value, test_value): those that `validate.measures` knows come from one pass, registered ones
    from their own.  Rows count with their `weight` if `df` has one.
    """
    keys, weight = ["trial_id", "fold", "split"], "weight" if "weight" in df.columns else None
    if metrics is None:
        return validate.train_test_pairs(validate.auc_of_runs(_score_runs(df, fits), keys), ["trial_id", "fold"])
    scores = stacked_scores(df, fits)
    stock = [m for m in metrics if not registry.known(m) or registry.lookup(m).build is None]
    if set(stock) == {"auc"}:
        found = validate.auc_of_runs(_score_runs(df, fits), keys)
        parts = [found.select(*keys, F.lit("auc").alias("metric"), F.col("auc").alias("value"))]
    else:
        parts = [validate.measures(scores, keys, stock, weight=weight)] if stock else []
    for m in metrics:
        if m not in stock:
            own = registry.lookup(m).build(scores, keys, weight)
            parts.append(own.select(*keys, F.lit(m).alias("metric"), F.col("value").cast("double").alias("value")))
    found = reduce(DataFrame.unionByName, parts)
    return validate.train_test_pairs(found, ["trial_id", "fold", "metric"], "value")


def cross_validate(
    df: DataFrame, estimator: Estimator, k: int = FOLDS, trial_id: int = 0, indices: Sequence[int] | None = None, parallelism: int = 4
) -> tuple[DataFrame, Fit]:
    """Fit k fold models and the final one on split 'A' of `df`; (AUC pair per fold, final fit)."""
    train = df.filter(F.col("split") == "A")
    jobs = [Job(trial_id, i, estimator, list(indices) if indices else None) for i in [*range(k), FINAL]]
    fits = fit_every(train, jobs, parallelism)
    set_margin_ranges(train, fits)
    return validate_fits(df, fits), next(f for f in fits if f.fold == FINAL)


def trial_values(pairs: DataFrame, preset: str | validate.Objective = "generalize") -> DataFrame:
    """(trial_id, cv, final, objective, train_value, test_value) from `validate_fits` rows.

    The blended value of every fold and of the final model are those of `validate.blend_metrics`; `cv` is the mean over the folds.  The last
    two columns are the final model's pair of the objective's first metric.  Rows without a `metric` are AUC pairs.
    """
    goal = validate.as_objective(preset)
    if "metric" not in pairs.columns:
        pairs = pairs.withColumn("metric", F.lit("auc"))
    pairs = through_table(pairs, "pairs")  # a few rows per trial, read three times: the scoring behind them runs once
    last = F.col("fold") == FINAL
    folds = validate.blend_metrics(pairs.filter(~last), goal.fold, ["trial_id", "fold"])
    ends = pairs.filter(last)
    first = F.col("metric") == goal.first
    final = validate.blend_metrics(ends, goal.final, ["trial_id"]).select("trial_id", F.col("blended").alias("final"))
    shown = ends.groupBy("trial_id").agg(
        F.max(F.when(first, F.col("train_value"))).alias("train_value"), F.max(F.when(first, F.col("test_value"))).alias("test_value")
    )
    values = validate.fold_mean(folds).join(final.join(shown, "trial_id"), "trial_id", "full_outer")
    objective = validate.blend(F.col("cv"), F.col("final"), goal.pair)
    return values.select("trial_id", "cv", "final", objective.alias("objective"), "train_value", "test_value")


def margin_stage(low: float, high: float) -> SQLTransformer:
    """A stage behind boosted trees that replaces their probability by the margin rule with the stored range of training margins."""
    # a vector's text holds its numbers so that they read back as they were; SQL has no other way into it
    margin = "CAST(trim(TRAILING ']' FROM split(CAST(rawPrediction AS STRING), ',')[1]) AS DOUBLE)"
    top, bottom = (f"CAST('{float(v)!r}' AS DOUBLE)" for v in (high, low))
    up = "0.5D" if high <= 0 else f"CASE WHEN m > {top} THEN 1.0D ELSE 0.5D * m / {top} + 0.5D END"
    down = "0.5D" if low >= 0 else f"CASE WHEN m < {bottom} THEN 0.0D ELSE 0.5D * ({bottom} - m) / {bottom} END"
    rule = f"element_at(transform(array({margin}), m -> CASE WHEN m >= 0 THEN {up} ELSE {down} END), 1)"
    return SQLTransformer(statement=f"SELECT *, {rule} AS {POSITIVE} FROM __THIS__")


def importances(fit: Fit, names: Sequence[str], rows: DataFrame | None = None) -> list[tuple[str, float]]:
    """(feature, importance): tree importances, or absolute coefficients scaled to sum 1.

    With `rows`, the table that the model was fitted on, a coefficient counts times its column's deviation, so columns of
    different units can be compared.
    """
    kept = [names[i] for i in fit.indices] if fit.indices is not None else list(names)
    if hasattr(fit.model, "featureImportances"):
        values = [float(v) for v in fit.model.featureImportances.toArray()]
    else:
        values = [abs(float(v)) for v in fit.model.coefficients.toArray()]
        if rows is not None:
            spread = sliced(rows, fit.indices, "_picked").select(
                Summarizer.metrics("std").summary(F.col("features" if fit.indices is None else "_picked")).alias("s")
            )
            values = [v * float(d) for v, d in zip(values, spread.select("s.std").first()[0].toArray())]
        whole = sum(values)
        values = [v / whole if whole > 0 else 0.0 for v in values]
    return list(zip(kept, values))
