"""The trial log as a table: (study_id, trial_id, ts, strategy, params, objective).

All operators treat any number of studies in one job.  Where a study's trials must be put in order, they are
cut into chunks first, so no task ever holds a whole study.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.functions import arrays
from tunekit.functions.scan import running, with_chunks
from tunekit.sources.session import through_table

STUDY = ["study_id"]
BEST = 10  # size of the best set
MIN_TRIALS, MAX_TRIALS, MAX_STEADY, TOLERANCE = 100, 10000, 20, 1e-4
SAME = 1e-6  # relative distance below which two vectors count as one
GAP_ROWS = 1 << 18  # rows of a log that one task looks for gaps in, about
CELL = 16  # width of a grid cell in such distances


def instant(ts: str = "ts") -> Column:
    """Microseconds of a timestamp without time zone: an order column for chunking."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def with_norm(trials: DataFrame) -> DataFrame:
    return trials.withColumn("norm", arrays.norm(F.col("params")))


def norm_span(trials: DataFrame) -> DataFrame:
    """(study_id, n_trials, min_norm, max_norm)."""
    return with_norm(trials).groupBy(*STUDY).agg(
        F.count(F.lit(1)).alias("n_trials"), F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm")
    )


def top_trials(trials: DataFrame, k: int = BEST) -> DataFrame:
    """The k best trials of every study with their `rank`, ties by trial_id.

    Spark applies the limit before the shuffle as well, so at most k rows per study and task travel.
    """
    w = Window.partitionBy(*STUDY).orderBy(F.desc("objective"), "trial_id")
    return trials.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_sets(trials: DataFrame, k: int = BEST) -> DataFrame:
    """(study_id, best): the k best trials as an array of (rank, trial_id, objective, params), best first."""
    cell = F.struct("rank", "trial_id", "objective", "params")
    return top_trials(trials, k).groupBy(*STUDY).agg(F.array_sort(F.collect_list(cell)).alias("best"))  # at most k


def latest_trials(trials: DataFrame) -> DataFrame:
    """(study_id, current): the last trial of every study as (ts, trial_id, objective, params)."""
    return trials.groupBy(*STUDY).agg(F.max(F.struct("ts", "trial_id", "objective", "params")).alias("current"))


def param_ranges(trials: DataFrame, n_params: int) -> DataFrame:
    """(study_id, low, high): smallest and largest value per parameter, as arrays.

    Plain aggregates per position: the log is not exploded.
    """
    cells = [f(F.element_at("params", i + 1)).alias(f"{n}{i}") for i in range(n_params) for n, f in (("lo", F.min), ("hi", F.max))]
    flat = trials.groupBy(*STUDY).agg(*cells)
    return flat.select(
        *STUDY, F.array(*[f"lo{i}" for i in range(n_params)]).alias("low"), F.array(*[f"hi{i}" for i in range(n_params)]).alias("high")
    )


def _along() -> Column:
    # an irrational-looking fixed direction; cos(i^2 + i) keeps lattice points apart
    weights = F.transform("params", lambda x, i: F.cos((i * i + i).cast("double")))
    return arrays.dot(F.col("params"), weights) / F.sqrt(F.size("params").cast("double"))


def _cell(value: Column, eps: float, moved: float = 0.0) -> Column:
    side = F.col("span") * F.lit(float(eps))
    return F.floor((value / side + F.lit(moved)) / F.lit(float(CELL)))


def _probes(mine: DataFrame, eps: float) -> DataFrame:
    """The candidates (norm, span, params, ...) with every grid cell (c1, c2) that may hold a match."""
    # half a distance more on both sides, for rounding
    reached = lambda v: F.explode(F.array_distinct(F.array(_cell(v, eps, -1.5), _cell(v, eps, 1.5))))
    rows = mine.withColumn("along", _along()).withColumn("c1", reached(F.col("norm"))).withColumn("c2", reached(F.col("along")))
    return rows.drop("along")


def near_duplicates(candidates: DataFrame, trials: DataFrame, eps: float = SAME) -> DataFrame:
    """Keys (study_id, slot) of candidates that repeat a past trial.

    A candidate repeats a trial when both norms and the vectors themselves are closer than eps times the
    study's norm span; trials that close to the candidate's `parent` vector do not count.  The search is an
    equi-join on a grid: a vector's norm and its projection on a fixed direction both move by at most the
    distance, so a match lies in a cell that this distance reaches on either axis.  Cells are `CELL` distances wide, so most
    candidates look into one cell only.  Equal trials are merged first, and candidates, not trials, are repeated for the other cells.
    """
    span = norm_span(trials).select(*STUDY, (F.col("max_norm") - F.col("min_norm")).alias("span")).filter("span > 0")
    seen = with_norm(trials.select(*STUDY, "params").distinct()).join(span, STUDY)
    mine = with_norm(candidates.select(*STUDY, "slot", "params", "parent")).join(span, STUDY)
    probe = _probes(mine, eps).alias("m")
    past = seen.select("*", _cell(F.col("norm"), eps).alias("c1"), _cell(_along(), eps).alias("c2"))
    past = past.select(*STUDY, "c1", "c2", F.col("params").alias("old"), F.col("norm").alias("old_norm"))
    limit = F.col("span") * F.lit(float(eps))
    # the whole log, which no driver holds however small its files are
    past = past.select(*[F.col(c).alias(f"_{c}") for c in (*STUDY, "c1", "c2")], "old", "old_norm").hint("merge")
    same = [F.col(c) == F.col(f"_{c}") for c in (*STUDY, "c1", "c2")]
    near = (
        (F.abs(F.col("norm") - F.col("old_norm")) < limit)
        & (arrays.distance(F.col("params"), F.col("old")) < limit)
        & (F.col("parent").isNull() | (arrays.distance(F.col("old"), F.col("parent")) >= limit))
    )
    # one past trial is enough, so no pair is ever put out
    hits = probe.join(past, [*same, near], "left_semi")
    return hits.select(*STUDY, "slot").distinct()


def drop_duplicates(candidates: DataFrame, trials: DataFrame, eps: float = SAME) -> DataFrame:
    """Candidates (study_id, slot, params, parent, ...) that repeat no past trial."""
    return candidates.join(near_duplicates(candidates, trials, eps), STUDY + ["slot"], "left_anti")


def largest_gap(df: DataFrame, keys: Sequence[str], value: str, id_col: str, payload: Column | None = None) -> DataFrame:
    """(keys..., n, low, high, balanced, lower, upper): the two neighbours around the widest gap of a group.

    n values go into n equal buckets; the widest jump between occupied buckets, the last on a tie, names the
    pair.  With every bucket occupied the group is `balanced` and the widest neighbour distance, the first on
    a tie, does; a constant group is balanced with one value as both ends.  `lower` and `upper` are
    (value, id, payload).  Buckets are scanned in blocks of about sqrt(n), then block by block.  The sizes of all groups are written
    first: they say into how many parts the blocks are dealt, so a task gets about `GAP_ROWS` rows of any log.
    """
    keys = list(keys)
    payload = payload if payload is not None else F.lit(None).cast("double")
    base = df.select(*keys, F.col(value).alias("v"), F.col(id_col).alias("id"), payload.alias("payload"))
    size = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    size = through_table(size, "sizes", merged=True)
    rows = size.agg(F.sum("n")).first()[0] or 0
    parts = max(ceil(rows / GAP_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    width = F.col("high") - F.col("low")
    place = F.least(F.floor((F.col("v") - F.col("low")) * F.col("n") / width), F.col("n") - 1)
    placed = base.join(size, keys).withColumn("bucket", F.when(width > 0, place).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("block", F.floor(F.col("bucket") / F.ceil(F.sqrt(F.col("n").cast("double")))))
    placed = placed.repartition(parts, *keys, "block")

    group = keys + ["n", "low", "high"]
    buckets = placed.groupBy(*group, "block", "bucket").agg(
        F.min(F.struct("v", "id", "payload")).alias("first"),
        F.max(F.struct("v", (-F.col("id")).alias("nid"), "payload")).alias("_last"),
    )
    last = F.struct(F.col("_last.v").alias("v"), (-F.col("_last.nid")).alias("id"), F.col("_last.payload").alias("payload"))
    buckets = buckets.withColumn("last", last)

    def candidates(prev_bucket: Column, prev_last: Column, bucket: Column, first: Column) -> tuple[Column, Column]:
        jump = F.struct((bucket - prev_bucket).alias("size"), bucket.alias("at"), prev_last.alias("lower"), first.alias("upper"))
        gap = F.struct((first["v"] - prev_last["v"]).alias("size"), (-bucket).alias("at"), prev_last.alias("lower"), first.alias("upper"))
        known = prev_bucket.isNotNull()
        return F.when(known, jump), F.when(known, gap)

    inner = Window.partitionBy(*group, "block").orderBy("bucket")
    jump, gap = candidates(F.lag("bucket").over(inner), F.lag("last").over(inner), F.col("bucket"), F.col("first"))
    blocks = (
        buckets.select(*group, "block", "bucket", "first", "last", jump.alias("jump"), gap.alias("gap"))
        .groupBy(*group, "block")
        .agg(
            F.max("jump").alias("jump"),
            F.max("gap").alias("gap"),
            F.min(F.struct("bucket", "first")).alias("head"),
            F.max(F.struct("bucket", "last")).alias("tail"),
        )
    )
    blocks = blocks.repartition(parts, *keys)
    outer = Window.partitionBy(*group).orderBy("block")
    tail = F.lag("tail").over(outer)
    jump, gap = candidates(tail["bucket"], tail["last"], F.col("head.bucket"), F.col("head.first"))
    whole = (
        blocks.select(*group, "head", F.col("jump").alias("j1"), F.col("gap").alias("g1"), jump.alias("j2"), gap.alias("g2"))
        .groupBy(*group)
        .agg(
            F.greatest(F.max("j1"), F.max("j2")).alias("jump"),
            F.greatest(F.max("g1"), F.max("g2")).alias("gap"),
            F.min("head").alias("head"),
        )
    )
    lonely = F.col("jump").isNull()
    balanced = lonely | (F.col("jump.size") == 1)
    pick = lambda side: F.when(lonely, F.col("head.first")).when(F.col("jump.size") == 1, F.col(f"gap.{side}")).otherwise(F.col(f"jump.{side}"))
    return whole.select(*keys, "n", "low", "high", balanced.alias("balanced"), pick("lower").alias("lower"), pick("upper").alias("upper"))


def farthest_pairs(trials: DataFrame) -> DataFrame:
    """`largest_gap` on the norms, payload (params, objective) of both trials."""
    payload = F.struct("params", "objective")
    return largest_gap(with_norm(trials), STUDY, "norm", "trial_id", payload)


def convergence(
    trials: DataFrame,
    tolerance: float = TOLERANCE,
    max_steady: int = MAX_STEADY,
    min_trials: int = MIN_TRIALS,
    max_trials: int = MAX_TRIALS,
) -> DataFrame:
    """Per trial in (ts, trial_id) order: run number, running best, steady count, and whether to stop there.

    The steady count grows while the best objective gains at most `tolerance` and restarts otherwise.  A study
    stops past `min_trials` runs once the count exceeds `max_steady`, or past `max_trials` runs.
    """
    cut = with_chunks(trials.select(*STUDY, "ts", "trial_id", "objective"), STUDY, instant())
    one = F.lit(1).cast("long")
    order = ["ts", "trial_id"]
    columns = cut.columns
    run = running(
        cut,
        STUDY,
        order,
        {"run": (one, "sum"), "best": (F.col("objective"), "max"), "_prev": (F.col("objective"), "max", False)},
    )
    moved = F.col("best") - F.coalesce(F.col("_prev"), F.lit(0.0)) > F.lit(float(tolerance))
    marked = run.select(*columns, "run", "best", F.when(moved, F.col("run")).alias("_at"))
    steady = running(marked, STUDY, order, {"_moved": (F.col("_at"), "max")})
    count = F.col("run") - F.coalesce(F.col("_moved"), F.lit(0))
    stop = (F.col("run") > min_trials) & ((F.col("run") > max_trials) | (count > max_steady))
    return steady.select(*STUDY, "trial_id", "run", "best", count.alias("steady"), stop.alias("stop"))


def convergence_summary(runs: DataFrame) -> DataFrame:
    """(study_id, n_trials, best, steady, stop_run): the state of every study; `stop_run` is null while it goes on."""
    return runs.groupBy(*STUDY).agg(
        F.max("run").alias("n_trials"),
        F.max("best").alias("best"),
        F.max_by("steady", "run").alias("steady"),
        F.min(F.when(F.col("stop"), F.col("run"))).alias("stop_run"),
    )


def accept_ratio(predicted: DataFrame, k: int = BEST) -> DataFrame:
    """(study_id, accept_ratio): surrogate error over the best set relative to its objectives.

    `predicted` is a trial log with a `prediction` column.
    """
    err = F.sum(F.abs(F.col("prediction") - F.col("objective")))
    whole = F.sum("objective")
    return top_trials(predicted, k).groupBy(*STUDY).agg(F.when(whole != 0, err / whole).alias("accept_ratio"))


def convergence_lines(summary: DataFrame, best: DataFrame) -> DataFrame:
    """One tab-separated text line per study: runs, steady count, accept ratio, then one field per best trial.

    A best trial is its parameters and its objective joined by commas, 6 decimals each.  `summary` holds
    (study_id, n_trials, steady, accept_ratio), `best` comes from `best_sets`.
    """
    text = lambda x: F.format_string("%.6f", x)
    field = F.transform(
        "best", lambda b: F.array_join(F.concat(F.transform(b["params"], text), F.array(text(b["objective"]))), ",")
    )
    line = F.concat_ws("\t", F.col("n_trials").cast("string"), F.col("steady").cast("string"), text(F.col("accept_ratio")), F.array_join(field, "\t"))
    state = summary.select(*STUDY, "n_trials", "steady", "accept_ratio")
    return state.join(best, STUDY).select(*STUDY, line.alias("line"))
