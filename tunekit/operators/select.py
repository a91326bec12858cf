"""Feature selection on assembled tables: L1 selection and backward elimination with a beam."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunekit.operators import validate
from tunekit.operators.columns import feature_names, slice_features
from tunekit.operators.train import FINAL, Job, fit_every, logistic, stacked_scores

ZERO = 1e-6  # coefficients up to this size count as 0
GAIN = 1e-3  # AUC gain that keeps a dropped feature dropped
BEAM = 3
GAIN_MEMORY = 1 - 0.1 ** (1 / 3)


@dataclass
class Selected:
    """A selection made on training rows: apply it to any table with the same vector."""

    names: list[str]
    indices: list[int]
    scores: list[tuple[str, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return slice_features(df, self.names)

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(n, float(v), n in self.names) for n, v in self.scores]
        return df.sparkSession.createDataFrame(rows, "feature string, score double, selected boolean")


def lasso(df: DataFrame, lam: float = 1e-3, names: Sequence[str] | None = None, max_iter: int = 100) -> Selected:
    """Keep features with a non-zero coefficient in an L1 logistic regression without intercept.

    When none is left, the one with the largest absolute coefficient, the first on a tie.
    """
    names = list(names) if names is not None else feature_names(df)
    model = logistic(lam, max_iter, elastic=1.0, intercept=False).fit(df)
    coefs = [float(v) for v in model.coefficients.toArray()]
    kept = [i for i, v in enumerate(coefs) if abs(v) > ZERO]
    if not kept:
        kept = [max(range(len(coefs)), key=lambda i: (abs(coefs[i]), -i))]
    return Selected([names[i] for i in kept], kept, list(zip(names, coefs)))


def above_threshold(coefs: DataFrame, keys: Sequence[str], coef: str = "coef", idx: str = "idx", zero: float = ZERO) -> DataFrame:
    """The L1 rule on a coefficient table: rows above the threshold, or the largest one of the group.

    A group is the coefficients of one model.
    """
    size = F.abs(F.col(coef))
    w = Window.partitionBy(*keys).orderBy(F.desc("_size"), idx)
    ranked = coefs.withColumn("_size", size).withColumn("_rank", F.row_number().over(w))
    # the first-ranked row is the largest: it stays in any case, and it alone when it is below the threshold
    return ranked.filter((F.col("_size") > F.lit(zero)) | (F.col("_rank") == 1)).drop("_size", "_rank")


def beam_topk(
    children: DataFrame, keys: Sequence[str], parent: str, features: str, score: str, per_parent: int, beam: int = BEAM
) -> DataFrame:
    """Best children of a generation: the `per_parent` best of each parent, then the `beam` best of all.

    Children with the same feature set, in any order, count once, with their best score.
    """
    keys = list(keys)
    named = children.withColumn(features, F.array_sort(features))
    once = named.groupBy(*keys, features).agg(
        F.max(score).alias(score), F.min_by(parent, F.struct(-F.col(score), F.col(parent))).alias(parent)
    )
    order = [F.desc(score), features]
    first = once.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, parent).orderBy(*order))).filter(F.col("_r") <= per_parent)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= beam)
    return ranked.select(*keys, parent, features, score, "rank")


def depth_limit(gain: float, u: float) -> int:
    """Generations to try, from the remembered gain and a uniform draw."""
    return max(int(u * math.ceil(max(gain, GAIN) / GAIN)), 1)


def remembered_gain(gain: float, total: float, depth: int) -> float:
    """Gain memory after a search of `depth` generations with `total` gain."""
    return gain if depth == 0 else (1 - GAIN_MEMORY) * gain + GAIN_MEMORY * total / depth


def backward_beam(
    df: DataFrame, max_depth: int | None = None, beam: int = BEAM, gain: float = GAIN, parallelism: int = 4, held_out: int = 0
) -> tuple[Selected, float, int]:
    """Drop features one at a time while the held-out AUC of an unregularised regression grows by `gain`.

    `df` needs a `fold` column: fold `held_out` is scored, the others are fitted.  A generation is a table of children
    (a parent without one of its features) with their scores, fitted together, scored in one job and ranked by
    `beam_topk`.  Generations are made while one gains, `max_depth` at most where it is given.  Returns (selection, total gain, generations that gained).
    """
    names = feature_names(df)
    data = df.withColumn("split", F.when(F.col("fold") == held_out, "B").otherwise("A"))
    train = data.filter(F.col("split") == "A")
    scored: dict[tuple[int, ...], float] = {}

    def score(sets: list[tuple[int, ...]]) -> None:
        jobs = [Job(i, FINAL, logistic(0.0), list(s)) for i, s in enumerate(sets)]
        fits = fit_every(train, jobs, parallelism)
        held = stacked_scores(data, fits).filter(F.col("split") == "B")
        found = validate.auc(held, ["trial_id"], weight="weight" if "weight" in data.columns else None).collect()
        scored.update({sets[r["trial_id"]]: r["auc"] for r in found})

    beams = [tuple(range(len(names)))]
    score(beams)
    total, depth = 0.0, 0
    for generation in count() if max_depth is None else range(max_depth):
        pairs = [(i, p[:d] + p[d + 1 :]) for i, p in enumerate(beams) if len(p) > 1 for d in range(len(p))]
        fresh = sorted({c for _, c in pairs} - scored.keys())
        if fresh:
            score(fresh)
        rows = [(i, list(c), scored[c]) for i, c in pairs if c in scored and scored[c] > scored[beams[i]] + gain]
        if not rows:
            break
        children = df.sparkSession.createDataFrame(rows, "parent int, features array<int>, score double")
        ranked = beam_topk(children, [], "parent", "features", "score", beam if generation == 0 else 1, beam)
        best = [tuple(r["features"]) for r in ranked.orderBy("rank").collect()]  # at most `beam` rows
        total += scored[best[0]] - max(scored[b] for b in beams)
        beams = best
        depth += 1
    chosen = max(beams, key=lambda b: scored[b])
    shares = [(n, 1.0 if i in chosen else 0.0) for i, n in enumerate(names)]
    return Selected([names[i] for i in chosen], list(chosen), shares), total, depth
