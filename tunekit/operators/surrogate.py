"""Surrogate models: predict a trial's objective from its parameters, per study, from the trial log.

The linear surrogate needs only means and covariances, so one aggregation serves all studies however large the log;
what reaches Python is one d x d matrix per study.  The boosted surrogate is one model per study as well, all grown
together level by level (`operators.boost`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import arrays
from tunekit.operators.boost import DEPTH, ROUNDS, boosted_surrogates, predicted
from tunekit.operators.trials import STUDY
from tunekit.sources.session import through_table

LAMBDA, ELASTIC = 0.1, 0.5
SWEEPS, SETTLED = 2000, 1e-12


def moments(trials: DataFrame, n_params: int) -> DataFrame:
    """(study_id, n, mean, cov, cov_y, mean_y, var_y, range): everything a linear fit needs.

    `cov` is the full n_params x n_params matrix, row by row.  One aggregation, combined before its shuffle.
    """
    x = [F.element_at("params", i + 1) for i in range(n_params)]
    y = F.col("objective")
    cells = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), F.var_pop(y).alias("var_y")]
    for i in range(n_params):
        cells += [F.avg(x[i]).alias(f"m{i}"), F.covar_pop(x[i], y).alias(f"y{i}")]
        cells += [F.min(x[i]).alias(f"lo{i}"), F.max(x[i]).alias(f"hi{i}")]
        cells += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for j in range(i, n_params)]
    flat = trials.groupBy(*STUDY).agg(*cells)
    d = range(n_params)
    return flat.select(
        *STUDY,
        "n",
        F.array(*[f"m{i}" for i in d]).alias("mean"),
        F.array(*[f"c{min(i, j)}_{max(i, j)}" for i in d for j in d]).alias("cov"),
        F.array(*[f"y{i}" for i in d]).alias("cov_y"),
        "mean_y",
        "var_y",
        F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in d]).alias("range"),
    )


def _elastic_net(
    cov: np.ndarray, cov_y: np.ndarray, var_y: np.ndarray, lam: float, elastic: float
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of many small regressions at once by coordinate descent on standardised moments, and which have settled.

    Shapes (s, d, d), (s, d), (s,).  Minimises |y - Xw|^2 / 2n plus the elastic-net penalty on standardised columns.
    """
    sd = np.sqrt(np.maximum(np.einsum("sii->si", cov), 0.0))
    sy = np.sqrt(np.maximum(var_y, 0.0))
    live = (sd > 0) & (sy > 0)[:, None]
    inv = np.where(live, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
    safe_y = np.where(sy > 0, sy, 1.0)
    corr = cov * inv[:, :, None] * inv[:, None, :]
    rho = cov_y * inv / safe_y[:, None]
    reg = lam / safe_y
    l1, l2 = elastic * reg, (1.0 - elastic) * reg
    w = np.zeros_like(rho)
    moved = np.zeros(len(w))
    for _ in range(SWEEPS):
        before = w.copy()
        for j in range(rho.shape[1]):
            part = rho[:, j] - np.einsum("sd,sd->s", corr[:, j, :], w) + corr[:, j, j] * w[:, j]
            shrunk = np.sign(part) * np.maximum(np.abs(part) - l1, 0.0)
            w[:, j] = np.where(live[:, j], shrunk / (1.0 + l2), 0.0)
        moved = np.abs(w - before).max(axis=1, initial=0.0)
        if moved.max(initial=0.0) < SETTLED:
            break
    return w * inv * safe_y[:, None], moved < SETTLED


def linear_surrogate(trials: DataFrame, n_params: int, lam: float = LAMBDA, elastic: float = ELASTIC) -> DataFrame:
    """(study_id, coefs, intercept, importances, converged): one elastic-net regression per study.

    `converged` is false where the coefficients still moved after `SWEEPS` sweeps.

    Importances are absolute coefficients on min-max scaled parameters, scaled to sum 1.  The penalty acts on
    standardised columns, so a fit on scaled parameters has the same coefficients times the ranges: no second fit.
    """
    table = moments(trials, n_params)
    study_type = table.schema["study_id"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s = len(pdf)
            stack = lambda c: np.array(pdf[c].tolist(), dtype=float)
            coefs, settled = _elastic_net(stack("cov").reshape(s, n_params, n_params), stack("cov_y"), pdf["var_y"].to_numpy(float), lam, elastic)
            weight = np.abs(coefs) * stack("range")
            whole = weight.sum(axis=1, keepdims=True)
            share = np.where(whole > 0, weight / np.where(whole > 0, whole, 1.0), 1.0 / n_params)
            yield pd.DataFrame(
                {
                    "study_id": pdf["study_id"],
                    "coefs": list(coefs),
                    "intercept": pdf["mean_y"].to_numpy(float) - np.einsum("sd,sd->s", coefs, stack("mean")),
                    "importances": list(share),
                    "converged": settled,
                }
            )

    schema = f"study_id {study_type}, coefs array<double>, intercept double, importances array<double>, converged boolean"
    return table.mapInPandas(solve, schema)


def linear_prediction() -> Column:
    return arrays.dot(F.col("params"), F.col("coefs")) + F.col("intercept")


def normalized(values: Column) -> Column:
    """Absolute values scaled to sum 1; equal shares when all are 0."""
    sizes = F.transform(values, lambda v: F.abs(v))
    share = lambda vs, whole: F.transform(vs, lambda v: F.when(whole > 0, v / whole).otherwise(1.0 / F.size(vs)))
    return arrays.let(sizes, lambda vs: arrays.let(arrays.total(vs), lambda whole: share(vs, whole)))


def blend_weights(predicted: DataFrame, learners: Sequence[str]) -> DataFrame:
    """(study_id, blend): weight per learner from its summed absolute error, as an array in the order given.

    weight_i = (m - err_i) / sum(m - err) with m = 1.001 max + min: the better learner weighs more, none gets 0.
    """
    errors = [F.sum(F.abs(F.col(c) - F.col("objective"))).alias(f"_e{i}") for i, c in enumerate(learners)]
    flat = predicted.groupBy(*STUDY).agg(*errors)
    cells = [F.col(f"_e{i}") for i in range(len(learners))]
    many = len(cells) > 1
    reach = (F.greatest(*cells) if many else cells[0]) * (1.0 + 1e-3) + (F.least(*cells) if many else cells[0])
    whole = sum((reach - c for c in cells[1:]), reach - cells[0])
    share = [F.when(whole > 0, (reach - c) / whole).otherwise(1.0 / len(cells)) for c in cells]
    return flat.select(*STUDY, F.array(*share).alias("blend"))


def blended(blend: str, learners: Sequence[str]) -> Column:
    """Weighted sum of prediction columns."""
    terms = [F.element_at(blend, i + 1) * F.col(c) for i, c in enumerate(learners)]
    return sum(terms[1:], terms[0])


LEARNERS = ["_linear", "_boost"]


@dataclass
class Surrogate:
    """Blend of the linear and the boosted surrogate; `state` has one row per study."""

    state: DataFrame  # study_id, coefs, intercept, importances, weights, blend and, unless left out, trees
    depth: int = DEPTH

    @property
    def boosted(self) -> bool:
        return "trees" in self.state.columns

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `prediction` to a table with (study_id, params); unknown studies drop out."""
        if not self.boosted:
            scored = df.join(self.state, STUDY).withColumn("_linear", linear_prediction())
            return scored.select(*[F.col(c) for c in df.columns], F.col("_linear").alias("prediction"))
        scored = predicted(df, self.state, self.depth)
        return scored.select(*[F.col(c) for c in df.columns], blended("blend", LEARNERS).alias("prediction"))

    def importances(self) -> DataFrame:
        """(study_id, importances, weights) as `propose.states` takes it."""
        return self.state.select(*STUDY, "importances", "weights")


def fit_surrogate(trials: DataFrame, n_params: int, boost: bool = True, rounds: int = ROUNDS, depth: int = DEPTH) -> Surrogate:
    """Fit both learners on a log of (study_id, params, objective) and weigh them per study by their errors on it.

    Importances are those of both learners, weighed like their predictions; `boost=False` leaves the boosted one out.
    """
    linear = linear_surrogate(trials, n_params)
    if not boost:
        state = linear.withColumn("weights", F.col("coefs")).withColumn("blend", arrays.lit_array([1.0]))
        return Surrogate(through_table(state, "surrogate", merged=True), depth)
    # written once: one row per study, read by the weights and by every later prediction
    state = through_table(linear.join(boosted_surrogates(trials, n_params, rounds, depth), STUDY), "surrogate", merged=True)
    scored = predicted(trials.select(*STUDY, "params", "objective"), state, depth)
    blend = blend_weights(scored, LEARNERS)
    a, b = F.element_at("blend", 1), F.element_at("blend", 2)
    state = (
        state.join(blend, STUDY)
        .withColumn("importances", F.zip_with("importances", "tree_importances", lambda x, t: a * x + b * t))
        .withColumn("weights", F.transform("coefs", lambda c: a * c))  # trees have no slopes
        .drop("tree_importances")
    )
    return Surrogate(through_table(state, "surrogate", merged=True), depth)
