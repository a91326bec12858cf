"""Exact validation metrics for any number of (trial, fold, split) groups in one job.

For the area under the curve scores travel as sorted runs: every task counts the ties of a buffer of rows and cuts what is left by the
leading bits of the score, so a group with most of the rows is spread over many parts; parts that are still too
large are cut by further bits.  A part is ranked in one task and handed on as one row.  The other metrics count scores per (group, score);
ranks are then built from two leading digits of the score: windows run inside a digit pair, inside a digit and over the
digits, and each step hands on one summary row per part.  Nothing is joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.functions.arrays import bind
from tunekit.functions.scan import digits
from tunekit.sources.session import through_table

RUN_ROWS, RUN_LENGTH = 1 << 20, 512  # rows whose ties are counted together, longest run in a row
WIDE_ROWS = 1 << 18  # the same for rows that hold the scores of several models
PART_ROWS = 1 << 21  # distinct scores of a part, about, that one task ranks in memory
PREFIXES = (20, 34, 48, 64)  # leading bits that cut a group into parts, level by level


def score_counts(
    scores: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """(keys..., score, pos, neg, d1, d2) with one row per distinct score; with `weight` sums of that column instead of counts."""
    s = F.col(score).cast("double")
    hit = F.col(label).cast("double") > 0.5
    d1, d2 = digits(F.col("score"))
    one = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    counted = (
        scores.select(*keys, (s + F.lit(0.0)).alias("score"), hit.alias("_y"), one.alias("_w"))
        .groupBy(*keys, "score")
        .agg(F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("_y"), 0.0).otherwise(F.col("_w"))).alias("neg"))
    )
    return bind(counted, d1=d1, d2=d2).select(*keys, "score", "pos", "neg", "d1", "d2")


def _ordered(score: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Integers in the order of the scores, bit by bit: missing ones first, NaN last."""
    score = np.where(np.isnan(score), np.nan, score + 0.0)  # one NaN, one zero
    bits = score.view(np.int64)
    code = np.where(bits < 0, np.bitwise_xor(~bits, np.iinfo(np.int64).min), bits)
    return np.where(missing, np.iinfo(np.int64).min, code)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    s = column.combine_chunks()
    return _ordered(s.fill_null(0.0).to_numpy(zero_copy_only=False), s.is_null().to_numpy(zero_copy_only=False))


def _groups(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row, equal for rows with equal keys."""
    group, size = np.zeros(table.num_rows, np.int64), 1
    for k in keys:
        own = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        if size * len(own.dictionary) >= 1 << 62:
            found, group = np.unique(group, return_inverse=True)
            size = len(found)
        group = group * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
        size *= len(own.dictionary)
    return group


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _tallied(group: np.ndarray, code: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first row, group, code, pos, neg) of every (group, code), in their order."""
    order = np.argsort(code)
    order = order[np.argsort(group[order], kind="stable")] if group.any() else order
    group, code = group[order], code[order]
    at = _starts(group, code)
    add = lambda x: np.add.reduceat(x[order], at) if len(at) else x[order]
    return order[at], group[at], code[at], add(pos), add(neg)


def _prefix(code: np.ndarray, bits: int) -> np.ndarray:
    return code >> (64 - bits) << (64 - bits)


def _packed(table: pa.Table, keys: Sequence[str], tallied: tuple[np.ndarray, ...], bits: int) -> pa.Table:
    """(keys..., part, n, code, pos, neg): runs of at most RUN_LENGTH scores of one part, each column of a run as bytes."""
    first, group, code, pos, neg = tallied
    part = _prefix(code, bits)
    new = _starts(group, part)
    inside = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
    at = np.flatnonzero(inside % RUN_LENGTH == 0)
    ends = np.append(at, len(code))
    blob = lambda x: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    cells = [table.column(k).take(pa.array(first[at])) for k in keys]
    cells += [pa.array(part[at]), pa.array(np.diff(ends)), blob(code), blob(pos.astype(float)), blob(neg.astype(float))]
    return pa.Table.from_arrays(cells, [*keys, "part", "n", "code", "pos", "neg"])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _opened(table: pa.Table, keys: Sequence[str]) -> tuple[pa.Table, tuple[np.ndarray, ...]]:
    """The runs of a table row by row: the table's keys with a row per score, and (group, code, pos, neg) beside them."""
    n = table.column("n").to_numpy()
    own = _groups(table, keys)
    cells = [_unpacked(table.column(c), k) for c, k in (("code", np.int64), ("pos", float), ("neg", float))]
    return np.repeat(np.arange(len(n)), n), (np.repeat(own, n), *cells)


def _buffered(batches: Iterator[pa.RecordBatch], size, limit: int = RUN_ROWS) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += size(b)
        if rows >= limit:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _runs(scores: DataFrame, keys: Sequence[str], score: str, label: str, weight: str | None) -> DataFrame:
    """Sorted runs of a table of scores, cut by the first of PREFIXES; ties of RUN_ROWS rows are counted before anything travels."""
    keys = list(keys)
    one = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    hit = F.coalesce(F.col(label).cast("double") > 0.5, F.lit(False))
    rows = scores.select(*keys, F.col(score).cast("double").alias("_s"), hit.alias("_y"), one.alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffered(batches, lambda b: b.num_rows):
            hits, w = table.column("_y").to_numpy(), table.column("_w").to_numpy()
            tallied = _tallied(_groups(table, keys), _codes(table.column("_s")), np.where(hits, w, 0.0), np.where(hits, 0.0, w))
            yield from _packed(table, keys, tallied, PREFIXES[0]).to_batches()

    return rows.mapInArrow(run, _run_schema(rows, keys))


def wide_runs(rows: DataFrame, outputs: Sequence[str], models: Sequence[tuple[int, int]], final: int, label: str = "label", weight: str | None = None) -> DataFrame:
    """(trial_id, fold, split, runs...) of rows (split, fold, label, one score per model), without a row per model on the way.

    `models` has the trial and the fold of every output.  A fold model counts the rows of split 'A', those of its own fold (or of none) as 'B';
    the model of fold `final` counts all rows, with their split.
    """
    one = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    hit = F.coalesce(F.col(label).cast("double") > 0.5, F.lit(False))
    train, none = F.coalesce(F.col("split") == "A", F.lit(False)), final - 1
    cells = [F.col(o) if fold == final else F.when(train, F.col(o)).alias(o) for o, (_, fold) in zip(outputs, models)]
    narrow = rows.select(train.alias("_a"), F.coalesce("fold", F.lit(none)).alias("_f"), hit.alias("_y"), one.alias("_w"), *cells)
    keys, outputs, models = ["trial_id", "fold", "split"], list(outputs), list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffered(batches, lambda b: b.num_rows, WIDE_ROWS):
            a, fold, hits, w = (table.column(c).to_numpy() for c in ("_a", "_f", "_y", "_w"))
            pos, neg = np.where(hits, w, 0.0), np.where(hits, 0.0, w)
            for output, (trial, left_out) in zip(outputs, models):
                code = _codes(table.column(output))
                if left_out == final:
                    side, own = np.where(a, 0, 1), slice(None)
                else:
                    side, own = np.where((fold != left_out) & (fold != none), 0, 1)[a], a
                _, group, *rest = _tallied(side, code[own], pos[own], neg[own])
                names = pa.table({"trial_id": pa.array([trial] * 2, pa.int64()), "fold": pa.array([left_out] * 2, pa.int32()), "split": ["A", "B"]})
                yield from _packed(names, keys, (group, group, *rest), PREFIXES[0]).to_batches()

    return narrow.mapInArrow(run, "trial_id bigint, fold int, split string, part bigint, n bigint, code binary, pos binary, neg binary")


def _run_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return f"{own}, part bigint, n bigint, code binary, pos binary, neg binary"


def _cut_again(runs: DataFrame, keys: Sequence[str], crowded: DataFrame, bits: int) -> DataFrame:
    """The runs with those of crowded parts cut by more leading bits."""
    keys = list(keys)
    part = [*keys, "part"]
    named = crowded.select(*[F.col(c).alias(f"_{c}") for c in part])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffered(batches, lambda b: int(np.sum(b.column("n").to_numpy()))):
            row, cells = _opened(table, keys)
            first, *rest = _tallied(*cells)
            yield from _packed(table, keys, (row[first], *rest), bits).to_batches()

    again = runs.join(named, same, "left_semi").mapInArrow(cut, _run_schema(runs, keys))
    return runs.join(named, same, "left_anti").unionByName(again)


def _ranked(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., part, pos, neg, pairs): one row per part, `pairs` those in the right order inside it."""
    keys = list(keys)
    part = [*keys, "part"]

    def whole(table: pa.Table) -> pa.Table:
        row, cells = _opened(table, part)
        first, group, _, pos, neg = _tallied(*cells)
        at = _starts(group)
        below = np.cumsum(neg) - neg
        below -= np.repeat(below[at], np.diff(np.append(at, len(group))))
        sums = [np.add.reduceat(x, at) for x in (pos, neg, pos * (below + neg / 2.0))]
        return pa.Table.from_arrays([*[table.column(c).take(pa.array(row[first[at]])) for c in part], *map(pa.array, sums)], [*part, "pos", "neg", "pairs"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for table in _buffered(batches, lambda b: int(np.sum(b.column("n").to_numpy()))):
            table = table if rest is None else pa.concat_tables([rest, table])
            last = int(_starts(_groups(table, part))[-1])  # rows come sorted: the last part may go on
            rest = table.slice(last)
            if last:
                yield from whole(table.slice(0, last)).to_batches()
        if rest is not None:
            yield from whole(rest).to_batches()

    own = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in part)
    return runs.repartition(*part).sortWithinPartitions(*part).mapInArrow(rank, f"{own}, pos double, neg double, pairs double")


def _pairs(runs: DataFrame, keys: Sequence[str], limit: int = PART_ROWS) -> DataFrame:
    """(keys..., pos, neg, pairs) from runs.

    The runs are written once, so that the scoring behind them runs once; parts of more than `limit` scores are then cut by more of their
    bits, at most as many times as there are PREFIXES.
    """
    keys = list(keys)
    part = [*keys, "part"]
    runs = through_table(runs, "runs")
    for bits in PREFIXES[1:]:
        crowded = through_table(runs.groupBy(*part).agg(F.sum("n").alias("n")).filter(F.col("n") > limit), "crowded")
        if crowded.isEmpty():
            break
        runs = through_table(_cut_again(runs, keys, crowded, bits), "runs")
    level = _ranked(runs, keys)
    below = F.coalesce(F.sum("neg").over(_before(keys, "part")), F.lit(0.0))
    level = level.withColumn("pairs", F.col("pairs") + F.col("pos") * below)
    return level.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pairs")])


def _before(part: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _nested(counts: DataFrame, keys: Sequence[str], pairs: bool, moves: bool, thresholds: Sequence[float] = ()) -> DataFrame:
    """One row per group from `score_counts`, by three nested aggregations: pos and neg; `pairs` in the right order; the largest and
    smallest (`top`, `bottom`) running difference of the two distributions; per threshold the positives and negatives at or above it."""
    keys = list(keys)
    sums = ["pos", "neg", *[f"_tp{i}" for i in range(len(thresholds))], *[f"_fp{i}" for i in range(len(thresholds))]]
    level = counts
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= F.lit(float(t))
        level = level.withColumn(f"_tp{i}", F.when(hit, F.col("pos")).otherwise(0.0))
        level = level.withColumn(f"_fp{i}", F.when(hit, F.col("neg")).otherwise(0.0))
    if pairs:
        level = level.withColumn("pairs", F.col("pos") * F.col("neg") / 2.0)
        sums.append("pairs")
    if moves:  # needs the class sizes up front: one row per group
        whole = counts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
        share = lambda c, w: F.coalesce(F.col(c) / F.nullif(F.col(w), F.lit(0.0)), F.lit(0.0))
        level = level.join(whole, keys).withColumn("move", share("neg", "_q") - share("pos", "_p"))
        level = level.withColumn("top", F.col("move")).withColumn("bottom", F.col("move"))
        sums.append("move")
    for part, order in ((keys + ["d1", "d2"], "score"), (keys + ["d1"], "d2"), (keys, "d1")):
        before = _before(part, order)
        if pairs:
            level = level.withColumn("pairs", F.col("pairs") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
        if moves:
            level = level.withColumn("_b", F.coalesce(F.sum("move").over(before), F.lit(0.0)))
        cells = [F.sum(c).alias(c) for c in sums]
        if moves:
            cells += [F.max(F.col("_b") + F.col("top")).alias("top"), F.min(F.col("_b") + F.col("bottom")).alias("bottom")]
        level = level.groupBy(*part).agg(*cells)
    return level


def _auc_value() -> Column:
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return F.when(both, F.col("pairs") / (F.col("pos") * F.col("neg"))).otherwise(F.lit(0.0))


def _ks_value() -> Column:
    return F.greatest(F.abs("top"), F.abs("bottom"))


def auc(
    scores: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """(keys..., auc, n_pos, n_neg): exact area under the ROC curve, ties counted half.

    The number of (positive, negative) pairs in the right order is a sum over nested parts: pairs inside a
    part plus positives of a part times negatives of the parts below it.  A group with one class only gets 0.
    With `weight` a pair counts the product of its weights; the counts are then the summed weights without their fractions.
    """
    keys = list(keys)
    return auc_of_runs(_runs(scores, keys, score, label, weight), keys)


def auc_of_runs(runs: DataFrame, keys: Sequence[str], limit: int = PART_ROWS) -> DataFrame:
    """`auc` of the runs that `wide_runs` makes."""
    level = _pairs(runs, keys, limit)
    return level.select(*keys, _auc_value().alias("auc"), F.col("pos").cast("long").alias("n_pos"), F.col("neg").cast("long").alias("n_neg"))


def ks(
    scores: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """(keys..., ks): largest distance between the score distributions of the two classes, with `weight` of the weighted ones.

    Needs the class sizes up front (one row per group); then a maximum of running sums over nested parts.
    """
    keys = list(keys)
    level = _nested(score_counts(scores, keys, score, label, weight), keys, pairs=False, moves=True)
    return level.select(*keys, _ks_value().alias("ks"))


RATES = ("sensitivity", "specificity", "precision", "f1")


def measures(
    scores: DataFrame, keys: Sequence[str], metrics: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """(keys..., metric, value) for several metrics from one pass over the counted scores.

    Metrics are `auc`, `ks` and, at a threshold, `sensitivity@0.5`, `specificity@0.5`, `precision@0.5` and `f1@0.5`.
    """
    keys = list(keys)
    rates = {m: (m.partition("@")[0], float(m.partition("@")[2])) for m in metrics if "@" in m}
    unknown = [m for m in metrics if m not in ("auc", "ks") and (m not in rates or rates[m][0] not in RATES)]
    if unknown or not metrics:
        raise ValueError(f"unknown metrics {unknown}" if unknown else "no metrics")
    levels = sorted({t for _, t in rates.values()})
    if set(metrics) == {"auc"}:
        row = _pairs(_runs(scores, keys, score, label, weight), keys)
    else:
        row = _nested(score_counts(scores, keys, score, label, weight), keys, "auc" in metrics, "ks" in metrics, levels)
    cells = []
    for m in metrics:
        if m in rates:
            kind, t = rates[m]
            i = levels.index(t)
            value = rate(kind, F.col(f"_tp{i}"), F.col(f"_fp{i}"), F.col("pos"), F.col("neg"))
        else:
            value = _auc_value() if m == "auc" else _ks_value()
        cells.append(F.struct(F.lit(m).alias("metric"), value.alias("value")))
    return row.select(*keys, F.explode(F.array(*cells)).alias("m")).select(*keys, "m.metric", "m.value")


def rate(kind: str, tp: Column, fp: Column, p: Column, q: Column) -> Column:
    """A rate of a threshold from its hits among p positives and q negatives; 0 where its denominator is."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    terms = {"sensitivity": (tp, p), "specificity": (q - fp, q), "precision": (tp, tp + fp), "f1": (2.0 * tp, p + tp + fp)}
    return share(*terms[kind])


THRESHOLDS = [i / 10 for i in range(1, 10)]


def threshold_metrics(
    scores: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = THRESHOLDS, score: str = "score", label: str = "label"
) -> DataFrame:
    """(keys..., threshold, sensitivity, specificity, precision, f1); positive means score >= threshold.

    One aggregation with a counter pair per threshold; rows are not multiplied by the thresholds.
    """
    keys = list(keys)
    pos = F.col(label) > 0.5

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, 1.0).otherwise(0.0))

    cells = [count(pos).alias("_p"), count(~pos).alias("_q")]
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(float(t))
        cells += [count(hit & pos).alias(f"_tp{i}"), count(hit & ~pos).alias(f"_fp{i}")]
    flat = scores.groupBy(*keys).agg(*cells)
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)
    ]
    long = flat.select(*keys, "_p", "_q", F.explode(F.array(*rows)).alias("r")).select(*keys, "_p", "_q", "r.*")

    cells = [F.col(c) for c in ("tp", "fp", "_p", "_q")]
    return long.select(*keys, "threshold", *[rate(kind, *cells).alias(kind) for kind in RATES])


def blend(x: Column, y: Column, w: Sequence[float] | Sequence[Column]) -> Column:
    """w1 x^2 + w2 y^2 + w3 x y + w4 x + w5 y."""
    w = [c if isinstance(c, Column) else F.lit(float(c)) for c in w]
    return w[0] * x * x + w[1] * y * y + w[2] * x * y + w[3] * x + w[4] * y


def train_test_pairs(values: DataFrame, keys: Sequence[str], value: str = "auc", split: str = "split") -> DataFrame:
    """(keys..., train_value, test_value) from rows per split ('A' train, 'B' test)."""
    side = lambda s: F.coalesce(F.max(F.when(F.col(split) == s, F.col(value))), F.lit(0.0))
    return values.groupBy(*keys).agg(side("A").alias("train_value"), side("B").alias("test_value"))


def blend_metrics(pairs: DataFrame, weights: dict[str, Sequence[float]], keys: Sequence[str]) -> DataFrame:
    """(keys..., blended): the polynomial of every metric's (train, test) pair, added up.

    `weights` names one five-tuple per metric, so it stays as small as the list of metrics and is inlined.
    """
    term = F.lit(None).cast("double")
    for metric, w in weights.items():
        term = F.when(F.col("metric") == metric, blend(F.col("train_value"), F.col("test_value"), w)).otherwise(term)
    return pairs.groupBy(*keys).agg(F.sum(term).alias("blended"))


# Objective presets as (fold weights, final weights, weights of the (cv, final) pair).
OBJECTIVES: dict[str, tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]] = {
    "squared_gap": ((-1.0, 1.0, 0.0, 0.0, 0.0), (-1.0, 1.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0, 0.0)),
    "generalize": ((0.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.5, 0.5)),
}


@dataclass(frozen=True)
class Objective:
    """What a trial is worth, from any number of metrics.

    `fold` and `final` name a five-tuple per metric for its (train, test) pair (see `blend`), in every fold and for the final model; the terms
    of all metrics are added up.  `pair` blends the mean over the folds with the final value.  Metrics are chain metrics or names that
    `measures` knows.
    """

    fold: dict[str, Sequence[float]]
    final: dict[str, Sequence[float]]
    pair: Sequence[float] = (0.0, 0.0, 0.0, 0.5, 0.5)

    def __post_init__(self) -> None:
        tuples = [*self.fold.values(), *self.final.values(), self.pair]
        if not self.fold or not self.final or any(len(w) != 5 for w in tuples):
            raise ValueError("an objective needs five weights per metric, for the folds and for the final model")

    @property
    def metrics(self) -> list[str]:
        return list(dict.fromkeys([*self.final, *self.fold]))

    @property
    def first(self) -> str:
        return next(iter(self.final))


def as_objective(preset: str | Objective, metric: str = "auc") -> Objective:
    """A preset by name, for one metric."""
    if isinstance(preset, Objective):
        return preset
    fold, final, pair = OBJECTIVES[preset]
    return Objective({metric: fold}, {metric: final}, pair)


def fold_mean(folds: DataFrame, value: str = "blended") -> DataFrame:
    """(trial_id, cv, n_folds): the mean of the folds' values."""
    return folds.groupBy("trial_id").agg(F.avg(value).alias("cv"), F.count(value).alias("n_folds"))


def objective(cv: Column, final: Column, preset: str = "generalize") -> Column:
    """One number for a trial from its cross-validated and its final blended value."""
    return blend(cv, final, OBJECTIVES[preset][2])


def margin_probability(margin: Column, low: Column | float, high: Column | float) -> Column:
    """Probability of a boosted-trees margin from the smallest and largest training margin.

    0.5 at margin 0, linear to 1 at the largest and to 0 at the smallest training margin.  A side without
    training margins of its sign has no slope: there it stays at 0.5.
    """
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    half = F.lit(0.5)
    up = F.when(high <= 0, half).when(margin > high, 1.0).otherwise(half * margin / high + half)
    down = F.when(low >= 0, half).when(margin < low, 0.0).otherwise(half * (low - margin) / low)
    return F.when(margin >= 0, up).otherwise(down)


def margin_range(train: DataFrame, margin: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., low, high) of the training margins: kept beside the model, never refitted on other rows."""
    return train.groupBy(*keys).agg(F.min(margin).alias("low"), F.max(margin).alias("high"))
