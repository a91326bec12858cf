"""A study: generations of trials on one training table until the search has settled."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.operators import propose as pr
from tunekit.operators import trials as tl
from tunekit.operators.surrogate import fit_surrogate
from tunekit.operators.validate import Objective
from tunekit.plans.chain import Chain
from tunekit.plans.generation import Outcome, next_candidates, run_candidates
from tunekit.sources.session import scratch, shared_folder
from tunekit.sources.sinks import append_table

LOG_SCHEMA = (
    "study_id bigint, trial_id bigint, generation int, slot int, ts timestamp_ntz, strategy string, parent array<double>, "
    "params array<double>, cv double, final double, train_value double, test_value double, objective double, error string"
)


@dataclass
class Limits:
    """When to stop; the numbers are those of `operators.trials` unless set."""

    min_trials: int = tl.MIN_TRIALS
    max_trials: int = tl.MAX_TRIALS
    max_steady: int = tl.MAX_STEADY
    tolerance: float = tl.TOLERANCE
    max_generations: int | None = None
    max_failed: int = 3  # generations in a row without any trial that ran to the end


@dataclass
class Study:
    """Searches the parameters of `chain` on `data` (features..., label).

    The trial log is a table in the cluster's shared folder: each generation appends to it and reads it back, so
    no lineage grows and nothing of it is kept on the driver but the generation at hand.
    """

    data: DataFrame
    features: Sequence[str]
    chain: Chain
    key: Sequence[str] | None = None
    slots: int = 4
    preset: str | Objective = "generalize"
    limits: Limits = field(default_factory=Limits)
    study_id: int = 0
    log_path: str | None = None
    parallelism: int = 4
    boost: bool = True
    attempts: int = pr.TRIES

    def __post_init__(self) -> None:
        self.spark = self.data.sparkSession
        if self.log_path is None:
            self.log_path = f"{shared_folder(self.spark)}/trials-{uuid.uuid4().hex}"
        self.chain = self.chain.bounded(self.data, self.features)
        self.failed = 0
        self.marked = self.chain.marked(self.data, self.features, self.key)
        self.ratio, self.factor = 0.2, 1.0
        self.generation = 0
        self.next_trial = 0
        self.best: list[Outcome] = []

    def log(self) -> DataFrame:
        """All trials so far, failed ones included."""
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)

    def trials(self) -> DataFrame:
        """Trials that ran to the end."""
        return self.log().filter(F.col("objective").isNotNull())

    def _append(self, outcomes: Sequence[Outcome], how: dict[int, tuple[int, str, list | None]]) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = []
        for o in outcomes:
            slot, strategy, parent = how[o.trial_id]
            values = (o.cv, o.final, o.train_value, o.test_value, o.objective, o.error)
            rows.append((self.study_id, o.trial_id, self.generation, slot, now, strategy, parent, o.params, *values))
        append_table(self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1), self.log_path)

    def _remember(self, outcomes: Sequence[Outcome]) -> None:
        done = [o for o in [*self.best, *outcomes] if o.objective is not None]
        self.best = sorted(done, key=lambda o: (-o.objective, o.trial_id))[: tl.BEST]

    def _first(self) -> list[tuple[int, str, list | None, list]]:
        start = self.chain.space.initial(self.spark.range(1).select(F.lit(self.study_id).cast("long").alias("study_id")), self.slots, f"init{self.generation}")
        return [(r["slot"], "initial", None, r["params"]) for r in start.orderBy("slot").collect()]

    def _next(self) -> list[tuple[int, str, list | None, list]]:
        trials = self.trials()
        surrogate = fit_surrogate(trials, len(self.chain.space), boost=self.boost)
        if self.generation > 1:
            ratio = tl.accept_ratio(surrogate.predict(trials)).first()
            if ratio is not None and ratio["accept_ratio"] is not None:
                self.ratio = min(max(ratio["accept_ratio"], 0.0), 1.0)
        found = next_candidates(
            trials, self.chain.space, self.slots, self.attempts, f"s{self.chain.seed}g{self.generation}", surrogate, self.ratio, self.factor
        ).collect()  # at most one row per slot
        distinct = {tuple(r["params"]): r for r in sorted(found, key=lambda r: -r["slot"])}
        missing = self.slots - len(distinct)
        # slots without a fresh candidate widen the search of the next generation; others let it calm down
        self.factor = max(1.0, self.factor * 2.0**missing * pr.ANNEAL ** len(distinct))
        rows = sorted(distinct.values(), key=lambda r: r["slot"])
        return [(r["slot"], r["strategy"], r["parent"], list(r["params"])) for r in rows]

    def step(self) -> list[Outcome]:
        """Run one generation; the tables it writes on the way are removed, the log stays."""
        with scratch():
            return self._step()

    def _step(self) -> list[Outcome]:
        chosen = self._first() if self.next_trial == 0 or not self.best else self._next()
        if not chosen:
            chosen = self._first()
        ids = range(self.next_trial, self.next_trial + len(chosen))
        how = {t: (slot, strategy, parent) for t, (slot, strategy, parent, _) in zip(ids, chosen)}
        outcomes = run_candidates(
            self.marked, self.chain, [(t, p) for t, (_, _, _, p) in zip(ids, chosen)], self.preset, self.parallelism
        )
        self._append(outcomes, how)
        self._remember(outcomes)
        self.failed = 0 if any(o.objective is not None for o in outcomes) else self.failed + 1
        self.next_trial += len(chosen)
        self.generation += 1
        return outcomes

    def convergence(self) -> DataFrame:
        limits = self.limits
        return tl.convergence(self.trials(), limits.tolerance, limits.max_steady, limits.min_trials, limits.max_trials)

    def finished(self) -> bool:
        if self.limits.max_generations is not None and self.generation >= self.limits.max_generations:
            return True
        if self.next_trial >= self.limits.max_trials or self.failed >= self.limits.max_failed:
            return True
        if self.next_trial <= self.limits.min_trials:
            return False
        with scratch():
            return tl.convergence_summary(self.convergence()).filter("stop_run IS NOT NULL").limit(1).count() > 0

    def run(self) -> "Study":
        self.data.persist()
        try:
            while not self.finished():
                self.step()
        finally:
            self.data.unpersist()
        return self
