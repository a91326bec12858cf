"""Proposal strategies: the next hyper-parameter vectors for all studies at once.

A strategy is a projection over the table of `states`: one row per (study, slot) with the study's current trial,
its best set and its parameter importances and weights, all of bounded size.  What a strategy needs from the
whole log (ranges, gaps) is aggregated per study first.  All draws are hashes of (study, slot, salt).

Every strategy returns (study_id, slot, strategy, params, parent), already clamped and rounded; a strategy that
has nothing to propose for a slot returns no row for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import arrays
from tunekit.functions.arrays import bind, let
from tunekit.functions.draws import gaussian, gaussian_nonnegative, normal, uniform
from tunekit.functions.scan import decayed_sum, running, with_chunks
from tunekit.operators import trials as tl
from tunekit.operators.space import BOOLEAN, Space

KEY = ["study_id", "slot"]
PEER_JITTER = 0.1 / 3  # deviation ratio of the jitter on best-set weights and on importances
STRATEGY_JITTER = 0.1
FORGET = 0.2  # share of the newest objective in a strategy's reward
TRIES = 10  # attempts over which the acceptance is widened to everything
ANNEAL = 0.5**0.1  # ten uses halve a widened step
FIRST_STEP = 0.1  # share of the objective used as a step while the best set shows no differences


def uniform_importances(n: int) -> Column:
    return arrays.lit_array([1.0 / n] * n)


def states(
    trials: DataFrame, space: Space, slots: int, importances: DataFrame | None = None, k: int = tl.BEST
) -> DataFrame:
    """(study_id, slot, current, best, importances, weights): the input of all strategies.

    `importances` is (study_id, importances, weights) of a surrogate; studies without a row, or all of them
    without the table, get equal importances and zero weights.
    """
    base = tl.latest_trials(trials).join(tl.best_sets(trials, k), tl.STUDY)
    return slotted(base, space, slots, importances)


def slotted(base: DataFrame, space: Space, slots: int, importances: DataFrame | None = None) -> DataFrame:
    """A row per slot of every study state, with the surrogate's importances and weights."""
    n = len(space)
    equal, none = uniform_importances(n), arrays.lit_array([0.0] * n)
    if importances is not None:
        base = base.join(importances, tl.STUDY, "left")
        base = base.withColumn("importances", F.coalesce("importances", equal)).withColumn("weights", F.coalesce("weights", none))
    else:
        base = base.withColumn("importances", equal).withColumn("weights", none)
    return base.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


def finish(df: DataFrame, proposed: Column, space: Space, strategy: str) -> DataFrame:
    """Clamp and round the proposed vectors and drop slots without a proposal."""
    kept = bind(df, proposed=proposed).filter(F.col("proposed").isNotNull())
    return kept.select(
        *KEY, F.lit(strategy).alias("strategy"), space.format(F.col("proposed")).alias("params"), F.col("current.params").alias("parent")
    )


def with_param(params: Column, idx: Column, value: Column) -> Column:
    """`params` with position `idx` replaced."""
    return F.transform(params, lambda x, i: F.when(i == idx, value).otherwise(x))


def spec_at(space: Space, idx: Column, attr: str) -> Column:
    return F.element_at(space.array(attr), idx + 1)


def pick_param(weights: Column, u: Column, n: int) -> Column:
    """Parameter index by roulette on its weight; evenly when all weights are 0."""
    return F.coalesce(arrays.roulette_index(weights, u), F.floor(u * n).cast("int"))


def raised(importances: Column) -> Column:
    """Importances plus their maximum: similar chances for every parameter."""
    return let(F.array_max(importances), lambda top: F.transform(importances, lambda w: w + top))


def peer_index(best: Column, salt: str) -> Column:
    """0-based index into the best set by roulette on the objective above the smallest one."""
    low = F.array_min(F.transform(best, lambda b: b["objective"]))
    jitter = lambda b, floor: gaussian_nonnegative(
        b["objective"] - floor, PEER_JITTER, normal([*KEY, b["trial_id"]], f"{salt}/peer")
    )
    weights = let(low - F.lit(1e-6) * F.abs(low), lambda floor: F.transform(best, lambda b: jitter(b, floor)))
    u = uniform(KEY, f"{salt}/pick")
    return F.coalesce(arrays.roulette_index(weights, u), F.floor(u * F.size(best)).cast("int"))


def _sign(salt: str) -> Column:
    return F.when(uniform(KEY, f"{salt}/sign") < 0.5, 1.0).otherwise(-1.0)


# ------------------------------------------------------------------ strategies on the state alone


def crossover(state: DataFrame, space: Space, salt: str = "cross") -> DataFrame:
    """Head of the current vector, tail of a best one; nothing to cross with a single parameter."""
    n = len(space)
    if n <= 1:
        return finish(state, F.col("current.params"), space, "crossover")
    cut = F.greatest(F.floor(uniform(KEY, f"{salt}/cut") * n).cast("int"), F.lit(1))
    df = bind(state, _cut=cut, _peer=peer_index(F.col("best"), salt))
    cut, peer = F.col("_cut"), F.element_at("best", F.col("_peer") + 1)["params"]
    both = F.concat(F.slice(F.col("current.params"), F.lit(1), cut), F.slice(peer, cut + 1, F.lit(n) - cut))
    return finish(df, both, space, "crossover")


def mutation(state: DataFrame, space: Space, salt: str = "mutate", factor: float = 1.0) -> DataFrame:
    """One parameter, chosen by jittered importance, drawn around its start point.

    The reach covers the present distance from the start point; `factor` widens it after duplicates.
    """
    weights = F.transform(
        "importances", lambda w, i: gaussian_nonnegative(w, PEER_JITTER, normal([*KEY, i], f"{salt}/weight"))
    )
    df = bind(state, _i=pick_param(weights, uniform(KEY, f"{salt}/idx"), len(space)))
    now = F.element_at(F.col("current.params"), F.col("_i") + 1)
    start = spec_at(space, F.col("_i"), "start")
    reach = F.abs(now - start) + spec_at(space, F.col("_i"), "pace") * F.abs(normal(KEY, f"{salt}/n"))
    drawn = start + _sign(salt) * uniform(KEY, f"{salt}/u") * reach * F.lit(float(factor))
    df = bind(df, _v=F.when(spec_at(space, F.col("_i"), "kind") == BOOLEAN, 1.0 - now).otherwise(drawn))
    return finish(df, with_param(F.col("current.params"), F.col("_i"), F.col("_v")), space, "mutation")


def regression_step(state: DataFrame, space: Space, salt: str = "regress", factor: float = 1.0) -> DataFrame:
    """A step from a best vector along the surrogate's weights.

    The step in objective units is the mean distance of the best set's objectives, nearer ones weighing more;
    it is split over the parameters so that the linear surrogate rises by it.
    """
    df = bind(state, _peer=peer_index(F.col("best"), salt))
    df = bind(df, _row=F.element_at("best", F.col("_peer") + 1))
    df = bind(df, _diffs=F.transform("best", lambda b: F.abs(b["objective"] - F.col("_row.objective"))))
    apart = F.filter("_diffs", lambda d: d > 0)
    df = bind(df, _top=F.array_max(apart), _low=F.array_min(apart))
    top = F.col("_top")
    df = bind(df, _near=F.transform("_diffs", lambda d: (top - d) / top))
    mean = arrays.dot(F.col("_near"), F.col("_diffs")) / arrays.total(F.col("_near"))
    spread = top.isNotNull() & (top != F.col("_low"))
    df = bind(df, _step=F.when(spread, mean).otherwise(F.col("_row.objective") * F.lit(FIRST_STEP)) * F.lit(float(factor)))
    return finish(df, climb(F.col("_row.params"), F.col("weights"), F.col("_step"), space), space, "regression")


def climb(params: Column, weights: Column, step: Column, space: Space) -> Column:
    """params + w step / |w|^2, or one pace each when all weights are 0."""
    paced = F.zip_with(params, space.array("pace"), lambda x, p: x + p)
    along = lambda rate: F.zip_with(params, weights, lambda x, w: x + w * rate)
    size = arrays.total(F.transform(weights, lambda w: w * w))
    rate = let(size, lambda q: F.when(q > 0, step / q))
    return let(rate, lambda r: F.when(r.isNotNull(), along(r)).otherwise(paced))


# ------------------------------------------------------------------ strategies that look at the whole log


def boundary_expand(state: DataFrame, trials: DataFrame, space: Space, salt: str = "expand") -> DataFrame:
    """One parameter moved beyond the range tried so far; parameters tried up to both bounds are out."""
    n = len(space)
    if "low" not in state.columns:
        state = state.join(tl.param_ranges(trials, n), tl.STUDY)
    full = F.zip_with(
        F.arrays_zip("low", "high"),
        F.arrays_zip(space.array("low").alias("a"), space.array("high").alias("b")),
        lambda h, s: (h["low"] <= s["a"]) & (h["high"] >= s["b"]),
    )
    weights = F.zip_with(raised(F.col("importances")), full, lambda w, f: F.when(f, 0.0).otherwise(w))
    df = bind(state, _i=arrays.roulette_index(weights, uniform(KEY, f"{salt}/idx")))
    idx = F.col("_i")
    now = F.element_at(F.col("current.params"), idx + 1)
    reach = spec_at(space, idx, "pace") * (1.0 + F.abs(normal(KEY, f"{salt}/n")))
    out = F.when(_sign(salt) > 0, F.element_at("high", idx + 1) + reach).otherwise(F.element_at("low", idx + 1) - reach)
    df = bind(df, _v=F.when(spec_at(space, idx, "kind") == BOOLEAN, 1.0 - now).otherwise(out))
    proposed = F.when(idx.isNotNull(), with_param(F.col("current.params"), idx, F.col("_v")))
    return finish(df, proposed, space, "expand")


def gap_midpoint(state: DataFrame, trials: DataFrame, space: Space, salt: str = "gap") -> DataFrame:
    """One parameter set to the middle of the widest gap in its history.

    No proposal where the history is even and reaches both bounds.  Only the chosen columns of the log are scanned.
    """
    chosen = bind(state, _i=pick_param(raised(F.col("importances")), uniform(KEY, f"{salt}/idx"), len(space)))
    if "gaps" in state.columns:
        kept = [c for c in chosen.columns if c not in ("low", "high", "gaps")]
        both = chosen.select(*kept, F.get("gaps", F.col("_i")).alias("_g"))
        low, high, ends = F.col("_g.low"), F.col("_g.high"), (F.col("_g.lower"), F.col("_g.upper"))
        return _gap_filled(both, space, F.col("_g.balanced"), low, high, ends)
    wanted = chosen.select(*tl.STUDY, "_i").distinct()
    history = trials.join(wanted, tl.STUDY).select(*tl.STUDY, "_i", "trial_id", F.element_at("params", F.col("_i") + 1).alias("v"))
    gaps = tl.largest_gap(history, [*tl.STUDY, "_i"], "v", "trial_id").drop("n")
    both = chosen.join(gaps, [*tl.STUDY, "_i"])
    return _gap_filled(both, space, F.col("balanced"), F.col("low"), F.col("high"), (F.col("lower.v"), F.col("upper.v")))


def _gap_filled(both: DataFrame, space: Space, balanced: Column, low: Column, high: Column, ends: tuple[Column, Column]) -> DataFrame:
    idx = F.col("_i")
    done = balanced & (low <= spec_at(space, idx, "low")) & (high >= spec_at(space, idx, "high"))
    middle = (ends[0] + ends[1]) / 2.0
    proposed = F.when(~done, with_param(F.col("current.params"), idx, middle))
    return finish(both, proposed, space, "gap")


def _ignited(state: DataFrame, trials: DataFrame) -> DataFrame:
    if "pair" in state.columns:
        both = state.select("*", F.col("pair.first").alias("_p"), F.col("pair.second").alias("_q"))
        return bind(both, _mid=arrays.midpoint(F.col("_p.params"), F.col("_q.params")))
    pairs = tl.farthest_pairs(trials).select(*tl.STUDY, F.col("lower.payload").alias("_p"), F.col("upper.payload").alias("_q"))
    return bind(state.join(pairs, tl.STUDY), _mid=arrays.midpoint(F.col("_p.params"), F.col("_q.params")))


def ignite(state: DataFrame, trials: DataFrame, space: Space) -> DataFrame:
    """Middle of the two vectors on both sides of the widest gap of norms."""
    return finish(_ignited(state, trials), F.col("_mid"), space, "ignite")


def ignite_mutation(state: DataFrame, trials: DataFrame, space: Space, salt: str = "ignmut", factor: float = 1.0) -> DataFrame:
    """`ignite`, then one parameter moved by at least one pace."""
    df = _ignited(state, trials)
    df = bind(df, _i=pick_param(raised(F.col("importances")), uniform(KEY, f"{salt}/idx"), len(space)))
    idx = F.col("_i")
    reach = spec_at(space, idx, "pace") * (F.lit(float(factor)) + F.abs(normal(KEY, f"{salt}/n")))
    flipped = 1.0 - F.element_at(F.col("current.params"), idx + 1)
    moved = F.element_at("_mid", idx + 1) + _sign(salt) * reach
    df = bind(df, _v=F.when(spec_at(space, idx, "kind") == BOOLEAN, flipped).otherwise(moved))
    return finish(df, with_param(F.col("_mid"), idx, F.col("_v")), space, "ignite_mutation")


def ignite_regression(state: DataFrame, trials: DataFrame, space: Space) -> DataFrame:
    """`ignite`, then a step of half the pair's objective distance along the surrogate's weights."""
    df = bind(_ignited(state, trials), _step=F.abs(F.col("_p.objective") - F.col("_q.objective")) / 2.0)
    return finish(df, climb(F.col("_mid"), F.col("weights"), F.col("_step"), space), space, "ignite_regression")


# The strategies a study chooses from, in their order.
STRATEGIES = ["crossover", "mutation", "regression", "expand", "gap", "ignite_regression", "ignite_mutation"]


def propose(strategy: str, state: DataFrame, trials: DataFrame, space: Space, salt: str, factor: float = 1.0) -> DataFrame:
    """Proposals of one strategy by name."""
    salt = f"{salt}/{strategy}"
    if strategy == "crossover":
        return crossover(state, space, salt)
    if strategy == "mutation":
        return mutation(state, space, salt, factor)
    if strategy == "regression":
        return regression_step(state, space, salt, factor)
    if strategy == "expand":
        return boundary_expand(state, trials, space, salt)
    if strategy == "gap":
        return gap_midpoint(state, trials, space, salt)
    if strategy == "ignite":
        return ignite(state, trials, space)
    if strategy == "ignite_regression":
        return ignite_regression(state, trials, space)
    if strategy == "ignite_mutation":
        return ignite_mutation(state, trials, space, salt, factor)
    raise ValueError(f"unknown strategy {strategy!r}")


# ------------------------------------------------------------------ choosing strategies and screening


def roulette_pick(df: DataFrame, keys: Sequence[str], weight: str, order: str, u: Column, item: str | None = None) -> DataFrame:
    """(keys..., item): per group the first item, by `order`, whose running weight reaches u times the whole.

    For weight tables of any length: running sums go chunk by chunk.  `u` is an expression of the keys.
    """
    keys = list(keys)
    item = item or order
    some = df.filter(F.col(weight) > 0).select(*dict.fromkeys([*keys, order, item, weight]))
    sums = running(with_chunks(some, keys, F.col(order)), keys, [order], {"_run": (F.col(weight), "sum")})
    hit = F.col("_run") >= u * F.col("_run_all")
    # rounding may leave the last running sum below u * whole: then the last item wins
    pair = F.struct(F.col(order), F.col(item).alias("_item"))
    picked = sums.groupBy(*keys).agg(F.coalesce(F.min(F.when(hit, pair)), F.max(pair)).alias("_pick"))
    return picked.select(*keys, F.col("_pick._item").alias(item))


def rewards(trials: DataFrame) -> DataFrame:
    """(study_id, strategy, n, reward): 1 to begin with, then after each trial 0.8 times itself plus 0.2 times the objective."""
    keys = [*tl.STUDY, "strategy"]
    decay = 1.0 - FORGET
    log = trials.select(*keys, "ts", "trial_id", "objective")
    sums = decayed_sum(with_chunks(log, keys, tl.instant()), keys, ["ts", "trial_id"], F.col("objective"), decay)
    reward = F.lit(FORGET) * F.col("total") + F.pow(F.lit(decay), F.col("n"))
    return sums.select(*keys, "n", reward.alias("reward"))


def strategy_table(studies: DataFrame, reward: DataFrame, names: Sequence[str] = STRATEGIES) -> DataFrame:
    """(study_id, rewards): reward per strategy in the order of `names`, 1 where a strategy has no trial yet."""
    cells = [F.max(F.when(F.col("strategy") == n, F.col("reward"))).alias(f"r{i}") for i, n in enumerate(names)]
    flat = studies.select(*tl.STUDY).join(reward.groupBy(*tl.STUDY).agg(*cells), tl.STUDY, "left")
    return flat.select(*tl.STUDY, F.array(*[F.coalesce(f"r{i}", F.lit(1.0)) for i in range(len(names))]).alias("rewards"))


def pick_strategy(
    table: DataFrame, slots: int, names: Sequence[str] = STRATEGIES, dead: Sequence[str] = (), salt: str = "strategy"
) -> DataFrame:
    """(study_id, slot, strategy): a roulette over jittered rewards above the smallest one; `dead` ones never.

    With a column `alive` (1 or 0 per strategy) a study never draws those that have nothing left to propose in it.
    """
    rows = table.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return with_strategy(rows, names, dead, salt).select(*KEY, "strategy")


def with_strategy(rows: DataFrame, names: Sequence[str] = STRATEGIES, dead: Sequence[str] = (), salt: str = "strategy") -> DataFrame:
    """`pick_strategy` for rows that have their slot: `rewards` and `alive` make way for `strategy`."""
    alive = F.array(*[F.lit(0.0 if n in dead else 1.0) for n in names])
    if "alive" in rows.columns:
        alive = F.zip_with("alive", alive, lambda a, b: a * b)
    low = F.array_min("rewards")
    df = bind(rows, _floor=low - F.lit(1e-6) * F.abs(low))
    floor = F.col("_floor")
    jittered = F.transform(
        "rewards", lambda r, i: F.greatest(gaussian(r - floor, STRATEGY_JITTER, normal([*KEY, i], f"{salt}/n")), F.lit(0.0))
    )
    weights = F.zip_with(jittered, alive, lambda w, a: w * a)
    df = bind(df, _i=arrays.roulette_index(weights, uniform(KEY, f"{salt}/u")))
    strategy = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    return df.withColumn("strategy", strategy).drop("rewards", "alive", "_floor", "_i")


def acceptance(estimate: Column, current: Column, ratio: Column | float, attempt: Column, u: Column) -> Column:
    """Whether a candidate is worth a fit: its estimate is no worse, or worse by little enough.

    The tolerated loss is a uniform share of `ratio`, widened linearly to 1 over ten attempts.
    """
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    wide = ratio + (1.0 - ratio) * attempt / F.lit(float(TRIES))
    loss = F.when(current != 0, 1.0 - estimate / current).otherwise(F.lit(0.0))
    return (estimate >= current) | (loss <= wide * u)


def screen(candidates: DataFrame, ratio: Column | float, salt: str = "screen", fallback: bool = False) -> DataFrame:
    """First accepted attempt per (study, slot), from (study_id, slot, attempt, estimate, current_objective, params, ...).

    With `fallback` a slot without an accepted attempt gets the one of the best estimate, of equal ones the first.
    """
    ok = acceptance(
        F.col("estimate"), F.col("current_objective"), ratio, F.col("attempt"), uniform([*KEY, "attempt"], salt)
    )
    rest = [c for c in candidates.columns if c not in (*KEY, "attempt")]
    row = F.struct("attempt", *rest)
    if fallback:
        worth = F.struct(F.nanvl(F.col("estimate"), F.lit(float("-inf"))), -F.col("attempt"))
        kept = candidates.groupBy(*KEY).agg(F.coalesce(F.min(F.when(ok, row)), F.max_by(row, worth)).alias("r"))
    else:
        kept = candidates.filter(ok).groupBy(*KEY).agg(F.min(row).alias("r"))
    return kept.select(*KEY, "r.*")


def widened_ratio(ratio: Column, duplicates: Column) -> Column:
    """Tolerated loss after so many duplicates: each closes a tenth of the distance to 1."""
    return F.least(1.0 - (1.0 - ratio) * F.pow(F.lit(1.0 - 1.0 / TRIES), duplicates), F.lit(1.0))


def widened_factor(factor: Column, duplicates: Column, uses: Column) -> Column:
    """Step factor after duplicates (each doubles it) and uses (ten halve it); never below 1."""
    return F.greatest(factor * F.pow(F.lit(2.0), duplicates) * F.pow(F.lit(ANNEAL), uses), F.lit(1.0))
