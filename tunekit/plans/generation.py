"""One generation: candidates for any number of studies, and the fits of one study's candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.operators import propose as pr
from tunekit.operators import train
from tunekit.operators import trials as tl
from tunekit.operators.space import Space
from tunekit.operators.state import spent, study_states
from tunekit.operators.surrogate import Surrogate, fit_surrogate
from tunekit.operators.validate import Objective, as_objective
from tunekit.plans.chain import Chain, Partial, Prepared
from tunekit.sources.session import through_table


def next_candidates(
    trials: DataFrame,
    space: Space,
    slots: int = 4,
    attempts: int = pr.TRIES,
    salt: str = "g",
    surrogate: Surrogate | None = None,
    ratio: Column | float = 0.2,
    factor: float = 1.0,
    names: Sequence[str] = pr.STRATEGIES,
    screened: bool = True,
) -> DataFrame:
    """(study_id, slot, attempt, strategy, params, parent, estimate): one candidate per slot, all studies at once.

    Each slot gets `attempts` proposals from strategies drawn by reward; near-duplicates of past trials drop
    out, the rest are numbered, then the surrogate screens them.  A slot without an accepted attempt gets the one of the
    best estimate.  Slots with nothing but duplicates are proposed again with other draws and doubled steps, `pr.TRIES`
    times; what is missing then belongs to a study whose space holds no new point within reach.
    With `screened=False` the attempts that are no duplicates come back instead.
    """
    surrogate = surrogate or fit_surrogate(trials, len(space))
    # the log is read for the states, once, and by the search for near-duplicates; proposals are projections of the states
    base = through_table(study_states(trials, len(space)), "states", merged=True)
    table = pr.strategy_table(base.select(*tl.STUDY), pr.rewards(trials), names)
    alive = base.select(*tl.STUDY, spent(base, names, space.array("low"), space.array("high")).alias("alive"))
    table = through_table(table.join(alive, tl.STUDY), "strategies", merged=True)
    # a study's row meets its rewards before it is repeated for the slots
    state = pr.slotted(base.join(table, tl.STUDY), space, slots * attempts, surrogate.importances())
    real = F.floor(F.col("slot") / attempts).cast("int")
    found, missing = [], None
    for again in range(pr.TRIES + 1):
        own = f"{salt}/again{again}" if again else salt
        rows = pr.with_strategy(state, names, salt=f"{own}/pick")
        if missing is not None:
            rows = rows.withColumn("real", real).join(missing, ["study_id", "real"], "left_semi").drop("real")
        # written once: each strategy reads only its own rows of it
        drawn = through_table(rows, "states", merged=True)
        parts = [pr.propose(n, drawn.filter(F.col("strategy") == n), trials, space, own, factor * 2.0**again) for n in names]
        proposals = through_table(reduce(DataFrame.unionByName, parts), "proposals", merged=True)
        fresh = tl.drop_duplicates(proposals, trials)
        current = drawn.select(*pr.KEY, F.col("current.objective").alias("current_objective"))
        scored = surrogate.predict(fresh).withColumnRenamed("prediction", "estimate").join(current, pr.KEY)
        scored = through_table(scored, "proposals", merged=True)
        found.append(scored)
        have = scored.select("study_id", real.alias("real"))
        missing = through_table(drawn.select("study_id", real.alias("real")).distinct().join(have, ["study_id", "real"], "left_anti"), "proposals", merged=True)
        if missing.isEmpty():
            break
    order = Window.partitionBy("study_id", "real").orderBy("slot")
    numbered = reduce(DataFrame.unionByName, found).withColumn("real", real)
    numbered = numbered.withColumn("attempt", F.row_number().over(order) - 1).withColumn("slot", F.col("real")).drop("real")
    return pr.screen(numbered, ratio, f"{salt}/screen", fallback=True) if screened else numbered


@dataclass
class Outcome:
    """What became of one candidate."""

    trial_id: int
    params: list[float]
    cv: float | None = None
    final: float | None = None
    objective: float | None = None
    train_value: float | None = None
    test_value: float | None = None
    error: str | None = None
    fit: train.Fit | None = None
    names: list[str] | None = None


def walk(
    chain: Chain, marked: DataFrame, vectors: dict[int, list[float]], failed: Callable[[list[int], Exception], None]
) -> Iterator[tuple[Prepared, list[int]]]:
    """(prepared table, candidates) for all candidates, each transform fitted once for all that agree on it and on those before it.

    The candidates are the leaves of a tree over the chain's transforms.  It is walked depth first; where it branches the table is cached and
    released behind the last branch, so at most one table per branching level is held.  The caller releases what it is given.
    Candidates behind a transform that fails are handed to `failed` with the error.
    """

    def down(partial: Partial, at: int, members: list[int]) -> Iterator[tuple[Prepared, list[int]]]:
        while at < len(chain.ops):
            branches: dict[tuple, list[int]] = {}
            for t in members:
                branches.setdefault(tuple(chain.values(vectors[t], at)) if chain.is_transform(at) else (), []).append(t)
            if len(branches) > 1:
                partial.keep()
                try:
                    for group in branches.values():
                        try:
                            following = chain.advance(partial, at, vectors[group[0]])
                        except Exception as e:  # noqa: BLE001 - a failed trial must not end the study
                            failed(group, e)
                            continue
                        yield from down(following, at + 1, group)
                finally:
                    partial.release()
                return
            try:
                partial = chain.advance(partial, at, vectors[members[0]])
            except Exception as e:  # noqa: BLE001
                failed(members, e)
                return
            at += 1
        yield chain.finish(partial), members

    if vectors:
        yield from down(chain.start(marked), 0, list(vectors))


def run_candidates(
    marked: DataFrame,
    chain: Chain,
    candidates: Sequence[tuple[int, Sequence[float]]],
    preset: str | Objective = "generalize",
    parallelism: int = 4,
) -> list[Outcome]:
    """Fit and validate candidates of one study.

    Candidates that agree in their first transforms share these (`walk`); those with equal transforms share one cached prepared
    table, all their models are scored in one pass and validated by one grouped job.  A candidate that fails is reported with its error.
    What searches of features gained is remembered at the end, in the order of the candidates.
    """
    out = {t: Outcome(t, [float(v) for v in p]) for t, p in candidates}
    gains: dict[int, list[tuple[float, int]]] = {t: [] for t in out}

    def failed(members: list[int], error: Exception) -> None:
        for t in members:
            out[t].error = train.reason(error)

    for prepared, members in walk(chain, marked, {t: o.params for t, o in out.items()}, failed):
        try:
            _run_group(prepared, chain, [out[t] for t in members], preset, parallelism, gains)
        finally:
            prepared.release()
    for t, _ in candidates:
        chain.remember(gains[t])
    return [out[t] for t, _ in candidates]


def _run_group(
    prepared: Prepared, chain: Chain, group: list[Outcome], preset: str | Objective, parallelism: int, gains: dict[int, list[tuple[float, int]]]
) -> None:
    rows = prepared.table.filter(F.col("split") == "A")
    goal = as_objective(preset, chain.metrics[0])
    at_once = max(1, min(parallelism, len(group)))

    def pick(o: Outcome) -> list[int] | None:
        try:
            return chain.select(prepared, o.params, max(1, parallelism // at_once), gains[o.trial_id])
        except Exception as e:  # noqa: BLE001
            o.error = train.reason(e)
            return None

    pool = ThreadPool(at_once)
    try:
        chosen = pool.map(inheritable_thread_target(prepared.table.sparkSession)(pick), group)
    finally:
        pool.close()
    jobs = [
        train.Job(o.trial_id, fold, chain.estimator(o.params), indices)
        for o, indices in zip(group, chosen)
        if o.error is None
        for fold in [*range(chain.folds), train.FINAL]
    ]
    fits = train.fit_all(rows, jobs, parallelism)
    by_id = {o.trial_id: o for o in group}
    for j in jobs:
        if j.error:
            by_id[j.trial_id].error = j.error
    fits = [f for f in fits if by_id[f.trial_id].error is None]
    if not fits:
        return
    train.set_margin_ranges(rows, fits)
    pairs = train.validate_fits(prepared.table, fits, goal.metrics)
    values = train.trial_values(pairs, goal).collect()  # one row per candidate
    for r in values:
        o = by_id[r["trial_id"]]
        o.cv, o.final, o.objective = r["cv"], r["final"], r["objective"]
        o.train_value, o.test_value = r["train_value"], r["test_value"]
    for f in fits:
        if f.fold == train.FINAL:
            o = by_id[f.trial_id]
            o.fit = f
            o.names = [prepared.names[i] for i in f.indices] if f.indices is not None else prepared.names
