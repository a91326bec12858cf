"""The state of a study in one row: all that proposals need of its log.

`study_states` reads a log; `advanced` brings states forward by a generation's few rows without it.  What is kept is bounded: the
best set, the latest trial, ranges, the span of norms, rewards and the steady count; the widest gaps, one pair per parameter
and one of norms, can only be found in the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import arrays
from tunekit.operators import trials as tl
from tunekit.sources.session import through_table

STUDY = tl.STUDY


def log_sums(trials: DataFrame, n_params: int) -> DataFrame:
    """(study_id, n_trials, current, low, high, min_norm, max_norm): one aggregation of the log."""
    d = range(n_params)
    norm = arrays.norm(F.col("params"))
    cells = [F.count(F.lit(1)).alias("n_trials"), F.max(F.struct("ts", "trial_id", "objective", "params")).alias("current")]
    cells += [F.min(norm).alias("min_norm"), F.max(norm).alias("max_norm")]
    cells += [f(F.element_at("params", i + 1)).alias(f"{n}{i}") for i in d for n, f in (("lo", F.min), ("hi", F.max))]
    low, high = (F.array(*[F.col(f"{n}{i}") for i in d]).alias(name) for n, name in (("lo", "low"), ("hi", "high")))
    return trials.groupBy(*STUDY).agg(*cells).select(*STUDY, "n_trials", "current", low, high, "min_norm", "max_norm")


def widest_gaps(trials: DataFrame, n_params: int) -> DataFrame:
    """(study_id, gaps, pair): the widest gap of every parameter as (balanced, low, high, lower, upper), and the two trials around the
    widest gap of norms as (first, second), each (trial_id, params, objective).

    Parameters and norms go through `largest_gap` together with nothing but their trial's id; the two trials are looked up at the end.
    """
    values = F.concat("params", F.array(arrays.norm(F.col("params"))))
    long = trials.select(*STUDY, "trial_id", F.posexplode(values).alias("at", "v"))
    found = through_table(tl.largest_gap(long, [*STUDY, "at"], "v", "trial_id"), "gaps", merged=True)
    cell = F.struct("balanced", "low", "high", F.col("lower.v").alias("lower"), F.col("upper.v").alias("upper"))
    own = [F.max(F.when(F.col("at") == i, cell)).alias(f"g{i}") for i in range(n_params)]
    gaps = found.groupBy(*STUDY).agg(*own).select(*STUDY, F.array(*[f"g{i}" for i in range(n_params)]).alias("gaps"))
    ends = found.where(F.col("at") == n_params).select(
        *STUDY, F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lower.id").alias("id")), F.struct(F.lit(1).alias("end"), F.col("upper.id").alias("id")))).alias("e")
    )
    ends = ends.select(F.col("study_id").alias("_study"), F.col("e.end").alias("end"), F.col("e.id").alias("_id"))
    trial = F.struct("trial_id", "params", "objective")
    named = trials.join(ends, (F.col("study_id") == F.col("_study")) & (F.col("trial_id") == F.col("_id")))
    sides = [F.max(F.when(F.col("end") == i, trial)).alias(n) for i, n in enumerate(("first", "second"))]
    pairs = named.groupBy(*STUDY).agg(*sides).select(*STUDY, F.struct("first", "second").alias("pair"))
    return gaps.join(pairs, STUDY)


def study_states(trials: DataFrame, n_params: int, k: int = tl.BEST, gaps: bool = True) -> DataFrame:
    """(study_id, n_trials, current, best, low, high, min_norm, max_norm) and, with `gaps`, (gaps, pair): one row per study."""
    rows = log_sums(trials, n_params).join(tl.best_sets(trials, k), STUDY)
    return rows.join(widest_gaps(trials, n_params), STUDY) if gaps else rows


def with_steady(states: DataFrame, runs: DataFrame) -> DataFrame:
    """States with (run_best, steady) as `trials.convergence` counts them."""
    return states.join(tl.convergence_summary(runs).select(*STUDY, F.col("best").alias("run_best"), "steady"), STUDY)


def merged(a: DataFrame, b: DataFrame, k: int = tl.BEST) -> DataFrame:
    """The states of two parts of a log, in any order and however it was divided; studies may be in one of them only.

    Counts add up, ranges widen, the later trial is the current one and the best sets are merged.  Without gaps, which two parts do not
    determine, and without steady counts, which need the order of trials (see `advanced`).
    """
    columns = ["n_trials", "current", "best", "low", "high", "min_norm", "max_norm"]
    left = a.select(*STUDY, *[F.col(c).alias(f"_a_{c}") for c in columns])
    both = left.join(b.select(*STUDY, *[F.col(c).alias(f"_b_{c}") for c in columns]), STUDY, "full_outer")

    def of(column: str, rule) -> Column:
        x, y = F.col(f"_a_{column}"), F.col(f"_b_{column}")
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(rule(x, y)).alias(column)

    each = lambda pick: lambda x, y: F.zip_with(x, y, lambda p, q: pick(p, q))
    return both.select(
        *STUDY,
        of("n_trials", lambda x, y: x + y),
        of("current", lambda x, y: F.greatest(x, y)),
        of("best", lambda x, y: best_of(F.concat(x, y), k)),
        of("low", each(F.least)),
        of("high", each(F.greatest)),
        of("min_norm", F.least),
        of("max_norm", F.greatest),
    )


def best_of(listed: Column, k: int) -> Column:
    """The first k of an array of (rank, trial_id, objective, params), ranked anew."""
    order = F.array_sort(F.transform(listed, lambda b: F.struct((-b["objective"]).alias("o"), b["trial_id"].alias("t"), b.alias("b"))))
    return F.transform(
        F.slice(order, 1, k),
        lambda s, i: F.struct((i + 1).cast("int").alias("rank"), s["b"]["trial_id"].alias("trial_id"), s["b"]["objective"].alias("objective"), s["b"]["params"].alias("params")),
    )


def advanced(states: DataFrame, rows: DataFrame, n_params: int, k: int = tl.BEST, tolerance: float = tl.TOLERANCE) -> DataFrame:
    """States after the rows of a generation: `merged`, and where they have (run_best, steady) these go on in order of (ts, trial_id).

    A generation has a few rows per study, which are gathered in one array.
    """
    out = merged(states, study_states(rows, n_params, k, gaps=False), k)
    if "steady" not in states.columns:
        return out
    step = F.array_sort(F.collect_list(F.struct("ts", "trial_id", "objective")))
    fresh = rows.groupBy(*STUDY).agg(step.alias("_rows"))
    start = F.struct(F.col("run_best").alias("best"), F.coalesce("steady", F.lit(0)).cast("long").alias("steady"))

    def fold(acc: Column, r: Column) -> Column:
        moved = F.greatest(acc["best"], r["objective"]) - F.coalesce(acc["best"], F.lit(0.0)) > F.lit(float(tolerance))
        count = F.when(moved, F.lit(0).cast("long")).otherwise(acc["steady"] + 1)
        return F.struct(F.greatest(acc["best"], r["objective"]).alias("best"), count.alias("steady"))

    seen = states.select(*STUDY, "run_best", "steady").join(fresh, STUDY, "full_outer")
    seen = seen.select(*STUDY, F.aggregate(F.coalesce("_rows", F.expr("array()").cast(fresh.schema["_rows"].dataType)), start, fold).alias("s"))
    return out.join(seen.select(*STUDY, F.col("s.best").alias("run_best"), F.col("s.steady").alias("steady")), STUDY)


def spent(states: DataFrame, names: Sequence[str], low: Column, high: Column) -> Column:
    """1 per strategy that still has something to propose, 0 otherwise, in the order of `names`, from a state with gaps.

    `crossover` needs two parameters, `expand` one that was not tried up to both bounds, `gap` one whose history is uneven or
    has not reached both bounds; `low` and `high` are the bounds as arrays.
    """
    reached = F.zip_with(
        F.arrays_zip(F.col("low"), F.col("high")), F.arrays_zip(low.alias("a"), high.alias("b")), lambda h, s: (h["low"] <= s["a"]) & (h["high"] >= s["b"])
    )
    open_range = F.exists(reached, lambda r: ~r)
    even = F.zip_with("gaps", reached, lambda g, r: g["balanced"] & r)
    rules = {"crossover": F.size("low") > 1, "expand": open_range, "gap": F.exists(even, lambda e: ~e)}
    return F.array(*[F.when(rules.get(n, F.lit(True)), 1.0).otherwise(0.0) for n in names])
