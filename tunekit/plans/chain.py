"""One chain: split, transforms, assembling, selection, training and validation, from one parameter vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.functions.draws import uniform, uniform_fast
from tunekit.operators import counted, registry, select, split, train
from tunekit.operators.columns import assemble
from tunekit.operators.evaluate import correlations
from tunekit.operators.prep import Prep
from tunekit.operators.prep.base import Fitted, quoted
from tunekit.operators.registry import METRIC, SELECTION, TRAINER, VECTOR, WIDE, place_of
from tunekit.operators.space import Space, chain_space
from tunekit.plans import stock  # noqa: F401 - registers the stock operators
from tunekit.sources.readers import spread

DEFAULT_CHAIN = ("split", "assemble", "minmax", "lasso", "lr", "auc")


@dataclass
class Prepared:
    """A prepared table (features, label, split, fold), its feature names and the fitted transforms."""

    table: DataFrame
    names: list[str]
    fitted: list[tuple[str, Fitted]]
    wide_names: list[str]
    evaluation: list[tuple[str, float]] = field(default_factory=list)

    def release(self) -> None:
        self.table.unpersist()


@dataclass
class Partial:
    """A table on its way through the transforms of a chain: what the operators before `at` have made of it."""

    table: DataFrame
    names: list[str]
    wide_names: list[str]
    fitted: list[tuple[str, Fitted]] = field(default_factory=list)
    evaluation: list[tuple[str, float]] = field(default_factory=list)
    cached: bool = False

    def keep(self) -> None:
        """Cache the table (spilling to disk), as several continuations will read it."""
        self.table, self.cached = self.table.persist(StorageLevel.MEMORY_AND_DISK), True

    def release(self) -> None:
        if self.cached:
            self.table.unpersist()
            self.cached = False


@dataclass
class Chain:
    """Operators by name, in order, with the data-dependent bounds of their parameters.

    Names are those of `operators.registry`, stock or registered by the user.  `n_features` bounds the codes of `power`, `n_rows` the
    centres of `rbf` (not at all where it is not given); `bounded` takes them from a table, as studies do, and a chain with `power` has no
    space before that.  `memory` is the gain that searches of `greedy` remember.  Transforms of wide tables come before `assemble`,
    transforms of vectors and the selection after it, then the trainer and its metrics.  `split` must come first: everything fitted
    looks at split 'A' only.
    """

    ops: Sequence[str] = DEFAULT_CHAIN
    n_features: int | None = None
    n_rows: float | None = None
    partitions: int | None = None
    ab_ratio: float = 1.0
    folds: int = train.FOLDS
    rel_error: float = 0.01
    rbf_mode: str = "sq"
    seed: int = 7
    memory: float = select.GAIN

    def __post_init__(self) -> None:
        unknown = [o for o in self.ops if not registry.known(o)]
        if unknown:
            raise ValueError(f"unknown operators {unknown}")
        ops = list(self.ops)
        places = [place_of(o) for o in ops]
        if not ops or ops[0] != "split":
            raise ValueError("a chain starts with 'split'")
        if "assemble" not in ops:
            raise ValueError("a chain needs 'assemble'")
        at = ops.index("assemble")
        late = [o for o, p in zip(ops[at:], places[at:]) if p == WIDE]
        early = [o for o, p in zip(ops[:at], places[:at]) if p in (VECTOR, SELECTION)]
        if late or early:
            raise ValueError(f"on the wrong side of 'assemble': {late + early}")
        if places.count(TRAINER) != 1:
            raise ValueError("a chain needs exactly one trainer")
        if not self.metrics:
            raise ValueError("a chain needs a validation after its trainer")
        if METRIC in places[: places.index(TRAINER)]:
            raise ValueError("validations come after the trainer")
        first = min((i for i, p in enumerate(places) if p == SELECTION), default=len(ops))
        if VECTOR in places[first:]:
            raise ValueError("transforms of vectors come before the selection")

    @property
    def trainer(self) -> str:
        return next(o for o in self.ops if place_of(o) == TRAINER)

    @property
    def metrics(self) -> list[str]:
        """The validations behind the trainer, in their order."""
        after = list(self.ops)[list(self.ops).index(self.trainer) :]
        return [o for o in after if place_of(o) == METRIC]

    @property
    def space(self) -> Space:
        if "power" in self.ops and self.n_features is None:
            raise ValueError("the codes of 'power' depend on the data: use `bounded`, or give n_features")
        return chain_space(self.ops, self.n_features or 1, self.n_rows or float("inf"))

    def bounded(self, df: DataFrame, features: Sequence[str]) -> Chain:
        """The chain with the bounds that are not given taken from a training table."""
        rows = self.n_rows
        if rows is None and "rbf" in self.ops:
            rows = float(df.count())
        return replace(self, n_features=self.n_features or len(features), n_rows=rows)

    def values(self, params: Sequence[float], at: int) -> list[float]:
        """The parameters of the operator at one place of the chain; an operator may stand in it several times."""
        sizes = [len(own) for own in self.space.ops]
        start = sum(sizes[:at])
        return list(params[start : start + sizes[at]])

    def is_transform(self, at: int) -> bool:
        return place_of(self.ops[at]) in (WIDE, VECTOR)

    def prep_key(self, params: Sequence[float]) -> tuple:
        """Equal for candidates that share their prepared table."""
        return tuple((op, tuple(self.values(params, i))) for i, op in enumerate(self.ops) if self.is_transform(i))

    def transform_for(self, at: int, params: Sequence[float]) -> Prep:
        return registry.lookup(self.ops[at]).build(self.values(params, at), self)

    def marked(self, df: DataFrame, features: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
        """(features..., label, split, fold), a projection of the input: one pass, and no shuffle unless `partitions` is set.

        With `key` the draws are those any SQL engine repeats; otherwise all columns are hashed.
        """
        portable = key is not None
        df = spread(df, self.partitions)
        out = split.ab_split(df, self.ab_ratio, key, f"a{self.seed}", portable)
        cols = list(key) if key else df.columns
        draw = uniform(cols, f"f{self.seed}") if portable else uniform_fast(cols, self.seed + 1)
        out = out.withColumn("fold", F.floor(draw * F.lit(float(self.folds))).cast("int"))
        if "balance" in self.ops:
            out = self._balanced(out, cols, portable)
        if "weigh" in self.ops:
            counts = split.class_counts(out.filter(F.col("split") == "A"))
            out = split.with_class_weights(out, counts)
        return out.select(*features, "label", "split", "fold", *(["weight"] if "weigh" in self.ops else []))

    def _balanced(self, df: DataFrame, cols: Sequence[str], portable: bool) -> DataFrame:
        """Thin the larger class of the training rows; test rows stay."""
        counts = split.class_counts(df.filter(F.col("split") == "A"))
        if not counts:
            return df
        least = min(counts.values())
        draw = uniform(cols, f"b{self.seed}") if portable else uniform_fast(cols, self.seed + 2)
        share = F.lit(1.0)
        for value, n in counts.items():
            share = F.when(F.col("label") == F.lit(value), F.lit(least / n)).otherwise(share)
        return df.filter((F.col("split") != "A") | (draw < share))

    def start(self, marked: DataFrame) -> Partial:
        """The table from `marked` before any transform."""
        names = [c for c in marked.columns if c not in (*self._extra(marked), "label")]
        return Partial(marked, names, names)

    @staticmethod
    def _extra(df: DataFrame) -> list[str]:
        return [c for c in ("split", "fold", "weight") if c in df.columns]

    def advance(self, partial: Partial, at: int, params: Sequence[float]) -> Partial:
        """Fit the operator at one place on split 'A' and apply it to all rows; places without preparation change nothing."""
        op, df, names = self.ops[at], partial.table, partial.names
        wide, fitted, evaluation = partial.wide_names, partial.fitted, partial.evaluation
        rows = df.filter(F.col("split") == "A")
        if self.is_transform(at):
            prep = self.transform_for(at, params)
            if place_of(op) == WIDE:
                prep.features = names
            done = prep.fit(rows)
            df, names = done.transform(df), done.names
            wide = names if place_of(op) == WIDE else wide
            fitted = [*fitted, (op, done)]
        elif op == "evaluate" and "features" not in df.columns:
            evaluation = [(r["feature"], r["corr"]) for r in correlations(rows, names).collect()]
        elif op == "assemble":
            df = assemble(df, names, keep=self._extra(df))
        return Partial(df, names, wide, fitted, evaluation)

    def finish(self, partial: Partial) -> Prepared:
        table = partial.table.select("features", "label", *self._extra(partial.table)).persist(StorageLevel.MEMORY_AND_DISK)
        return Prepared(table, partial.names, partial.fitted, partial.wide_names, partial.evaluation)

    def prepare(self, marked: DataFrame, params: Sequence[float]) -> Prepared:
        """Fit the transforms on split 'A', apply them to all rows and cache the outcome (spilling to disk)."""
        partial = self.start(marked)
        for at in range(len(self.ops)):
            partial = self.advance(partial, at, params)
        return self.finish(partial)

    def select(
        self, prepared: Prepared, params: Sequence[float], parallelism: int = 4, gains: list[tuple[float, int]] | None = None
    ) -> list[int] | None:
        """Indices of the selected features; None without a selection operator.

        What searches gained is added to `gains` for the caller to remember; without that list the chain remembers it at once.
        """
        chosen: list[int] | None = None
        rows = prepared.table.filter(F.col("split") == "A")
        noted: list[tuple[float, int]] = []
        for at, op in enumerate(self.ops):
            if place_of(op) != SELECTION:
                continue
            view = rows if chosen is None else select.slice_features(rows, [prepared.names[i] for i in chosen])
            build, values = registry.lookup(op).build, self.values(params, at)
            found = build(view, values, self, params, parallelism, noted) if op == "greedy" else build(view, values, self)
            chosen = found.indices if chosen is None else [chosen[i] for i in found.indices]
        if gains is not None:
            gains += noted
        else:
            self.remember(noted)
        return chosen

    def remember(self, gains: Sequence[tuple[float, int]]) -> None:
        for total, done in gains:
            self.memory = select.remembered_gain(self.memory, total, done)

    def estimator(self, params: Sequence[float]):
        at = list(self.ops).index(self.trainer)
        return registry.lookup(self.trainer).build(self.values(params, at), self)

    def pipeline(self, prepared: Prepared, fit: train.Fit) -> PipelineModel:
        """The fitted chain as stock stages on the wide input: it can be saved, loaded and applied as it is."""
        stages = [s for op, f in prepared.fitted if place_of(op) == WIDE for s in f.stages()]
        inputs = prepared.wide_names
        for place, (op, f) in enumerate(prepared.fitted):
            if place_of(op) == VECTOR and f.enabled:
                if (whole := f.prelude(inputs)) is not None:
                    stages.append(SQLTransformer(statement=f"SELECT *, {whole} AS {quoted(f'{op}{place}_all')} FROM __THIS__"))
                cells = f.cells(inputs, f"{op}{place}_all")
                inputs = [f"{op}{place}_{i}" for i in range(len(cells))]
                added = ", ".join(f"{e} AS {quoted(c)}" for c, e in zip(inputs, cells))
                stages.append(SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__"))
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
        column = "features"
        if fit.indices is not None:
            stages.append(VectorSlicer(inputCol=column, outputCol="features_selected", indices=fit.indices))
            column = "features_selected"
        if fit.cuts is not None:
            read = inputs if fit.indices is None else [inputs[i] for i in fit.indices]
            codes = [f"{self.trainer}_code_{i}" for i in range(len(read))]
            stages.append(counted.coder(fit.cuts, read, codes))
            column = "features_coded"
            stages.append(VectorAssembler(inputCols=codes, outputCol=column, handleInvalid="error"))
        stages.append(fit.model.copy().setFeaturesCol(column))
        if fit.margins is not None:
            stages.append(train.margin_stage(*fit.margins))
        return PipelineModel(stages)


def start_params(chain: Chain) -> list[float]:
    """The start point of a chain's space, clamped, with switched parameters in place."""
    return [min(max(p.start, p.low), p.high) for p in chain.space.params]
