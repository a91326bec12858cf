"""Boosted regression trees for many problems at once: one model per study of a trial log.

Parameters are coded by the study's own quantile cuts, and trials with equal codes are added up to a cell: trees cannot tell
them apart, so cells give the trees that rows give.  Studies of at most `LOCAL_CELLS` cells are boosted where their cells meet, all
studies of a task at once.  Larger ones are grown level by level over the whole cluster: a level is one aggregation
of residual sums keyed (study, node, parameter, code), combined before its shuffle, so however many cells a study has, a
few thousand sums of it travel.  Both ways choose the same splits.  A tree is an array of nodes of bounded size (the children of
node i are 2 i + 1 and 2 i + 2), kept in a table of one row per study, and applying one is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunekit.functions import arrays
from tunekit.functions.arrays import quoted
from tunekit.operators.trials import STUDY
from tunekit.sources.session import through_table

ROUNDS, DEPTH, CODES = 10, 5, 32  # fixed values: rounds, depth and histogram size of the boosted surrogate
STEP = 0.1  # fixed value: share of every tree but the first
LOCAL_CELLS = 1 << 14
TASK_CELLS, TASK_SUMS = 1 << 18, 1 << 21
LEAF = -1  # `feature` of a node that is not split

NODE = "struct<feature:int,code:int,threshold:double,value:double>"
TREE = f"array<{NODE}>"


def quantile_cuts(trials: DataFrame, n_params: int, codes: int = CODES) -> DataFrame:
    """(study_id, cuts): per parameter the distinct values at `codes` - 1 even quantiles, ascending; a sketch of bounded size."""
    points = F.array(*[F.lit(i / codes) for i in range(1, codes)])
    cells = [F.percentile_approx(F.element_at("params", i + 1), points, 10_000).alias(f"q{i}") for i in range(n_params)]
    flat = trials.groupBy(*STUDY).agg(*cells)
    return flat.select(*STUDY, F.array(*[F.array_distinct(f"q{i}") for i in range(n_params)]).alias("cuts"))


def coded_cells(trials: DataFrame, cuts: DataFrame) -> DataFrame:
    """(study_id, codes, n, objective): trials with equal codes, counted and added up.

    A code is the number of cuts below a parameter's value, so value <= cut j means code <= j.
    """
    code = F.zip_with("params", "cuts", lambda v, cs: F.size(F.filter(cs, lambda c: c < v)))
    rows = trials.select(*STUDY, "params", "objective").join(cuts, STUDY).select(*STUDY, code.alias("codes"), "objective")
    return rows.groupBy(*STUDY, "codes").agg(F.count(F.lit(1)).alias("n"), F.sum("objective").alias("objective"))


def node_of(nodes: Column, depth: int, goes_right: object) -> Column:
    """Index of the node where a row ends up; `goes_right(node)` is a condition on a node struct."""

    def step(at: Column, _: Column) -> Column:
        node = F.get(nodes, at)
        return F.when(node["feature"] == LEAF, at).otherwise(at * 2 + 1 + F.when(goes_right(node), 1).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def tree_value(nodes: Column, params: Column, depth: int) -> Column:
    """A tree's value for a parameter vector."""
    at = node_of(nodes, depth, lambda n: F.get(params, n["feature"]) > n["threshold"])
    return F.get(nodes, at)["value"]


def boosted_prediction(trees: Column, params: Column, depth: int = DEPTH, step: float = STEP) -> Column:
    """The first tree's value plus `step` times the others'."""
    values = F.transform(trees, lambda t, i: tree_value(t, params, depth) * F.when(i == 0, 1.0).otherwise(step))
    return arrays.total(values)


def predicted(rows: DataFrame, state: DataFrame, depth: int = DEPTH, step: float = STEP) -> DataFrame:
    """`rows` (study_id, params, ...) with `_linear`, `_boost` and `blend` from a state (study_id, coefs, intercept, trees and, if it has one, blend).

    Rows and states are sorted by study, a state before its rows, and read as a stream, so trees are never copied to rows and a task holds
    one batch of either.  The values are those of `boosted_prediction` and of coefs x params + intercept; unknown studies drop out.
    """
    own = [c for c in ("coefs", "intercept", "trees", "blend") if c in state.columns]
    study = F.col("study_id")
    a = rows.where(study.isNotNull()).select(study.alias("_s"), F.lit(1).alias("_kind"), F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("_row"))
    b = state.where(study.isNotNull()).select(study.alias("_s"), F.lit(0).alias("_kind"), F.struct(*own).alias("_state"))
    both = a.unionByName(b, allowMissingColumns=True).repartition("_s").sortWithinPartitions("_s", "_kind")
    schema = T.StructType([both.schema["_row"], *[T.StructField(c, T.DoubleType()) for c in ("_linear", "_boost")], T.StructField("blend", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (study, state) that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("_kind").to_numpy()
            studies, states = batch.column("_s"), batch.column("_state").filter(pa.array(kind == 0))
            named = studies.filter(pa.array(kind == 0))
            at = np.cumsum(kind == 0) - 1
            if last is not None:
                named, states, at = pa.concat_arrays([last[0], named]), pa.concat_arrays([last[1], states]), at + 1
            if len(named):
                last = (named.slice(len(named) - 1), states.slice(len(states) - 1))
            mine = np.flatnonzero((kind == 1) & (at >= 0))
            same = pc.equal(studies.take(pa.array(mine)), named.take(pa.array(at[mine]))).to_numpy(zero_copy_only=False) if len(mine) else np.zeros(0, bool)
            mine = mine[same]
            if len(mine):
                found = batch.column("_row").take(pa.array(mine))
                linear, boost, blend = _scores_of(found.field("params"), states, at[mine], depth, step)
                yield pa.RecordBatch.from_arrays([found, linear, boost, blend], ["_row", "_linear", "_boost", "blend"])

    return both.mapInArrow(run, schema).select("_row.*", "_linear", "_boost", "blend")


def _scores_of(params: pa.Array, states: pa.StructArray, at: np.ndarray, depth: int, step: float) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(linear, boosted, blend weights) of parameter vectors, each by the state at its place."""
    n = pc.list_value_length(params).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    flat = params.flatten()
    x, known = np.zeros((len(n), n.max(initial=1))), np.zeros((len(n), n.max(initial=1)), bool)
    x[row, place] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    known[row, place] = flat.is_valid().to_numpy(zero_copy_only=False)

    coefs = states.field("coefs")
    width = pc.list_value_length(coefs).to_numpy(zero_copy_only=False)
    slope = np.array(coefs.flatten()).reshape(len(states), -1)[at]
    linear = np.zeros(len(n))
    whole = (n == width[at]) & (known.sum(1) == n)
    for j in range(min(x.shape[1], slope.shape[1])):
        linear = linear + x[:, j] * slope[:, j]
    linear = linear + states.field("intercept").to_numpy(zero_copy_only=False)[at]

    trees = states.field("trees").flatten()
    nodes = trees.flatten()
    shape = (len(states), len(trees) // len(states), -1)
    feature, threshold, value = (nodes.field(c).to_numpy(zero_copy_only=False).reshape(shape) for c in ("feature", "threshold", "value"))
    boost, rows = np.zeros(len(n)), np.arange(len(n))
    for t in range(feature.shape[1]):
        node = np.zeros(len(n), np.int64)
        for _ in range(depth):
            f = feature[at, t, node]
            here = np.minimum(np.maximum(f, 0), x.shape[1] - 1)
            v = x[rows, here]
            right = known[rows, here] & (f < x.shape[1]) & ((v > threshold[at, t, node]) | np.isnan(v))
            node = np.where(f == LEAF, node, node * 2 + 1 + right)
        boost = boost + value[at, t, node] * (1.0 if t == 0 else step)
    names = [states.type.field(i).name for i in range(states.type.num_fields)]
    blend = states.field("blend").take(pa.array(at)) if "blend" in names else pa.nulls(len(n), pa.list_(pa.float64()))
    return pa.array(linear, mask=~whole), pa.array(boost), blend


def _stumps(state: DataFrame, depth: int) -> DataFrame:
    """The state with an empty tree: one leaf without a value."""
    leaf = F.struct(F.lit(LEAF).alias("feature"), F.lit(0).alias("code"), F.lit(0.0).alias("threshold"), F.lit(0.0).alias("value"))
    return state.withColumn("tree", F.array_repeat(leaf, 2 ** (depth + 1) - 1).cast(TREE))


def best_splits(rows: DataFrame, state: DataFrame, level: int, min_rows: int = 1) -> DataFrame:
    """(study_id, node, split) for the nodes of a level: the split of the largest gain in squared error.

    `rows` has (study_id, codes, n, residual: the sum over its n trials), `state` (study_id, cuts, tree).  A split is (feature, code, threshold, gain, value, left,
    right): rows with at most that code go left, and the last three are mean residuals.  Ties go to the first parameter, then the
    smallest code; a node without a split that gains and leaves `min_rows` rows on both sides has a null feature.
    """
    nodes = F.col("tree")
    placed = rows.join(state.select(*STUDY, "tree"), STUDY)
    at = node_of(nodes, level, lambda n: F.get("codes", n["feature"]) > n["code"]) if level else F.lit(0)
    placed = placed.select(*STUDY, at.alias("node"), "codes", "n", "residual").where(F.col("node") >= 2**level - 1)
    cell = placed.select(*STUDY, "node", "n", "residual", F.posexplode("codes").alias("feature", "code"))
    part = [*STUDY, "node", "feature"]
    sums = cell.groupBy(*part, "code").agg(F.sum("residual").alias("s"), F.sum("n").alias("n"))
    upto = Window.partitionBy(*part).orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    sums = sums.select(
        *part, "code",
        F.sum("s").over(upto).alias("ls"), F.sum("n").over(upto).alias("ln"),
        F.sum("s").over(whole).alias("ts"), F.sum("n").over(whole).alias("tn"),
    )
    rs, rn = F.col("ts") - F.col("ls"), F.col("tn") - F.col("ln")
    gain = F.col("ls") * F.col("ls") / F.col("ln") + rs * rs / rn - F.col("ts") * F.col("ts") / F.col("tn")
    fits = (F.col("ln") >= min_rows) & (rn >= min_rows) & (rn > 0)
    size = F.col("ts") * F.col("ts") / F.col("tn")
    worth = F.when(fits & (gain > (size + 1.0) * 1e-12), gain)
    # values near each other in the last digits count as equal, so that the order of additions does not choose
    rounded = F.round(worth, 9)
    best = F.max(
        F.struct(
            rounded.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("code")).alias("c"),
            (F.col("ls") / F.col("ln")).alias("left"), F.when(rn > 0, rs / rn).alias("right"), (F.col("ts") / F.col("tn")).alias("value"),
        )
    ).alias("b")
    found = sums.groupBy(*STUDY, "node").agg(best)
    split = F.struct(
        F.when(F.col("b.gain").isNotNull(), -F.col("b.f")).alias("feature"), (-F.col("b.c")).alias("code"),
        "b.gain", "b.value", "b.left", "b.right",
    )
    return found.select(*STUDY, "node", split.alias("split"))


def grown(state: DataFrame, splits: DataFrame, n_params: int) -> DataFrame:
    """The state with a level's splits in its trees and their gains added up per parameter (`gains`)."""
    listed = F.map_from_entries(F.collect_list(F.struct("node", "split")))  # at most as many as a level has nodes
    both = state.join(splits.groupBy(*STUDY).agg(listed.alias("_m")), STUDY, "left")

    def renewed(node: Column, i: Column) -> Column:
        own = F.try_element_at("_m", i)
        split = own["feature"].isNotNull()
        above = F.try_element_at("_m", F.floor((i - 1) / 2).cast("int"))
        child = (i > 0) & above["feature"].isNotNull()
        value = F.when(child, F.when(i % 2 == 1, above["left"]).otherwise(above["right"])).otherwise(
            F.coalesce(own["value"], node["value"])
        )
        threshold = F.get(F.get("cuts", own["feature"]), own["code"])
        return F.struct(
            F.when(split, own["feature"]).otherwise(node["feature"]).cast("int").alias("feature"),
            F.when(split, own["code"]).otherwise(node["code"]).cast("int").alias("code"),
            F.when(split, threshold).otherwise(node["threshold"]).alias("threshold"),
            value.cast("double").alias("value"),
        )

    def gain_of(param: int) -> Column:
        own = F.filter(F.map_values("_m"), lambda s: s["feature"] == param)
        return F.coalesce(arrays.total(F.transform(own, lambda s: s["gain"])), F.lit(0.0))

    gained = F.array(*[gain_of(p) for p in range(n_params)])
    return both.withColumn("tree", F.transform("tree", renewed)).withColumn(
        "gains", F.zip_with("gains", gained, lambda a, b: a + b)
    ).drop("_m")


def boosted_surrogates(
    trials: DataFrame,
    n_params: int,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    codes: int = CODES,
    step: float = STEP,
    min_rows: int = 1,
    local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """(study_id, trees, tree_importances) of every study of a log (study_id, params, objective), by `rounds` rounds of squared error.

    The first tree fits the objective, every later one twice what is left of it, of which `step` is added.  Importances are gains per
    parameter, each tree's scaled to sum 1, then their mean; equal shares where no tree is split.  Trials without an objective do not
    count.  What is written on the way is one table of cells and, for studies beyond `local_cells`, one table per level.
    """
    log = trials.where("objective IS NOT NULL")
    cuts = through_table(quantile_cuts(log, n_params, codes), "cuts", merged=True)
    cells = through_table(coded_cells(log, cuts), "cells")
    sizes = through_table(cells.groupBy(*STUDY).agg(F.count(F.lit(1)).alias("cells")), "sizes", merged=True)
    small, large = sizes.where(F.col("cells") <= local_cells), sizes.where(F.col("cells") > local_cells)
    whole = small.agg(F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("studies")).first()
    parts = max(1, ceil((whole["cells"] or 0) / TASK_CELLS), ceil(whole["studies"] * 2 ** max(depth - 1, 0) * n_params * codes / TASK_SUMS))
    kind = cells.schema["study_id"].dataType.simpleString()
    spread = cells.join(small.select(*STUDY), STUDY, "left_semi").join(cuts, STUDY)
    spread = spread.withColumn("part", F.pmod(F.xxhash64(*STUDY), F.lit(parts)))
    columns = ["study_id", "codes", "n", "objective", "cuts"]

    def fit(table: pa.Table) -> pa.Table:
        return boosted_here(table.select(columns), n_params, rounds, depth, codes, step, min_rows)

    found = spread.groupBy("part").applyInArrow(fit, f"study_id {kind}, trees array<{TREE}>, tree_importances array<double>")
    if not large.isEmpty():
        own = large.select(*STUDY)
        parts_of = (cells.join(own, STUDY, "left_semi"), cuts.join(own, STUDY, "left_semi"))
        found = found.unionByName(boosted_by_levels(*parts_of, n_params, rounds, depth, step, min_rows))
    return through_table(found, "trees", merged=True)


def boosted_by_levels(cells: DataFrame, cuts: DataFrame, n_params: int, rounds: int, depth: int, step: float, min_rows: int) -> DataFrame:
    """`boosted_surrogates` from cells of any number: one written job per level, so a lost executor costs one level."""
    zero = arrays.lit_array([0.0] * n_params)
    rows = cells.withColumn("residual", F.col("objective")).withColumn("reached", F.lit(0.0))
    state = cuts.withColumn("trees", F.array().cast(f"array<{TREE}>")).withColumn("shares", zero)
    for turn in range(rounds):
        grown_state = _stumps(state, depth).withColumn("gains", zero)
        for level in range(depth):
            splits = best_splits(rows, grown_state, level, min_rows)
            grown_state = through_table(grown(grown_state, splits, n_params), "trees", merged=True)
        whole = arrays.total(F.col("gains"))
        share = F.when(whole > 0, F.transform("gains", lambda g: g / whole)).otherwise(zero)
        state = grown_state.select(
            *STUDY, "cuts", F.concat("trees", F.array("tree")).alias("trees"),
            F.zip_with("shares", share, lambda a, b: a + b).alias("shares"),
        )
        if turn + 1 < rounds:
            added = F.get("tree", node_of(F.col("tree"), depth, lambda n: F.get("codes", n["feature"]) > n["code"]))["value"]
            reached = F.col("reached") + added * (1.0 if turn == 0 else step)
            moved = rows.join(grown_state.select(*STUDY, "tree"), STUDY)
            moved = moved.select(*STUDY, "codes", "n", "objective", reached.alias("reached"))
            rows = through_table(moved.withColumn("residual", (F.col("objective") - F.col("n") * F.col("reached")) * 2.0), "boost")
    whole = arrays.total(F.col("shares"))
    equal = arrays.lit_array([1.0 / n_params] * n_params)
    found = F.when(whole > 0, F.transform("shares", lambda s: s / whole)).otherwise(equal)
    return state.select(*STUDY, "trees", found.alias("tree_importances"))


def boosted_here(
    table: pa.Table, n_params: int, rounds: int, depth: int, n_codes: int, step: float, min_rows: int
) -> pa.Table:
    """`boosted_surrogates` of all studies of a table (study_id, codes, n, objective, cuts), level by level for all of them at once."""
    encoded = table.column("study_id").combine_chunks().dictionary_encode()
    names, study = encoded.dictionary, encoded.indices.to_numpy()
    code = np.array(table.column("codes").combine_chunks().flatten()).reshape(len(study), n_params)
    n, y = (table.column(c).to_numpy().astype(float) for c in ("n", "objective"))
    first = np.unique(study, return_index=True)[1]
    cuts = table.column("cuts").take(pa.array(first)).to_pylist()
    cut = np.zeros((len(names), n_params, n_codes))
    for s, own in enumerate(cuts):
        for p, values in enumerate(own):
            cut[s, p, : len(values)] = values
    size = 2 ** (depth + 1) - 1
    reached, shares = np.zeros(len(study)), np.zeros((len(names), n_params))
    trees = []
    for turn in range(rounds):
        residual = y if turn == 0 else (y - n * reached) * 2.0
        feature, at_code = np.full((len(names), size), LEAF, np.int32), np.zeros((len(names), size), np.int32)
        value, gains = np.zeros((len(names), size)), np.zeros((len(names), n_params))
        node = np.zeros(len(study), np.int64)
        for level in range(depth):
            active = np.flatnonzero(node >= 2**level - 1)
            if not len(active):
                break
            groups, group = np.unique(study[active] * size + node[active], return_inverse=True)
            place = ((group[:, None] * n_params + np.arange(n_params)) * n_codes + code[active]).ravel()
            shape = (len(groups), n_params, n_codes)
            sums = np.bincount(place, np.repeat(residual[active], n_params), int(np.prod(shape))).reshape(shape).cumsum(2)
            counts = np.bincount(place, np.repeat(n[active], n_params), int(np.prod(shape))).reshape(shape).cumsum(2)
            best = chosen_splits(sums, counts, min_rows)
            of, at = np.divmod(groups, size)
            value[of[at == 0], 0] = best.value[at == 0] if level == 0 else value[of[at == 0], 0]
            split = np.isfinite(best.gain)
            of, at = of[split], at[split]
            feature[of, at], at_code[of, at] = best.feature[split], best.code[split]
            value[of, 2 * at + 1], value[of, 2 * at + 2] = best.left[split], best.right[split]
            np.add.at(gains, (of, best.feature[split]), best.gain[split])
            goes = split[group]
            moved = active[goes]
            right = code[moved, best.feature[group[goes]]] > best.code[group[goes]]
            node[moved] = 2 * node[moved] + 1 + right
        reached = reached + value[study, node] * (1.0 if turn == 0 else step)
        whole = gains.sum(1, keepdims=True)
        shares += np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0)
        rows = np.arange(len(names))[:, None]
        threshold = np.where(feature == LEAF, 0.0, cut[rows, np.maximum(feature, 0), at_code])
        trees.append((feature, at_code, threshold, value))
    whole = shares.sum(1, keepdims=True)
    found = np.where(whole > 0, shares / np.where(whole > 0, whole, 1.0), 1.0 / n_params)
    parts = [np.stack([t[i] for t in trees], 1).ravel() for i in range(4)]
    nodes = pa.StructArray.from_arrays([pa.array(x) for x in parts], ["feature", "code", "threshold", "value"])
    lists = pa.ListArray.from_arrays(np.arange(0, len(nodes) + 1, size, dtype=np.int32), nodes)
    outer = pa.ListArray.from_arrays(np.arange(0, len(lists) + 1, rounds, dtype=np.int32), lists)
    flat = pa.ListArray.from_arrays(np.arange(0, found.size + 1, n_params, dtype=np.int32), pa.array(found.ravel()))
    return pa.Table.from_arrays([names, outer, flat], ["study_id", "trees", "tree_importances"])


@dataclass
class Splits:
    """Of every node: the best split, its gain (minus infinity without one) and the mean residuals."""

    feature: np.ndarray
    code: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray


def chosen_splits(sums: np.ndarray, counts: np.ndarray, min_rows: int) -> Splits:
    """The rule of `best_splits` for running sums and counts of shape (nodes, parameters, codes)."""
    total, whole = sums[:, :, -1:], counts[:, :, -1:]
    right, rest = total - sums, whole - counts
    fits = (counts >= min_rows) & (rest >= min_rows) & (rest > 0) & (counts > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        size = total * total / whole
        gain = sums * sums / counts + right * right / rest - size
        gain = np.where(fits & (gain > (size + 1.0) * 1e-12), np.round(gain, 9), -np.inf)
        flat = gain.reshape(len(gain), -1)
        best = flat.argmax(1)
        pick = lambda x: x.reshape(len(x), -1)[np.arange(len(x)), best]
        feature, code = np.divmod(best, sums.shape[2])
        return Splits(
            feature, code, pick(gain), (total / whole)[:, 0, 0], pick(sums / counts), pick(right / np.where(rest > 0, rest, 1.0))
        )


def stump_table(trials: DataFrame, n_params: int, codes: int = CODES) -> DataFrame:
    """(study_id, feature, threshold, value, left, right): the first split of every study; feature -1 where none gains."""
    state = boosted_surrogates(trials, n_params, rounds=1, depth=1, codes=codes)
    node = [F.get(F.get("trees", F.lit(0)), F.lit(i)) for i in range(3)]
    return state.select(
        *STUDY, node[0]["feature"].alias("feature"), node[0]["threshold"].alias("threshold"), node[0]["value"].alias("value"),
        node[1]["value"].alias("left"), node[2]["value"].alias("right"),
    )
