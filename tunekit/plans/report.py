"""Reports of the best chains: parameters and fitted constants as a table, models as saved pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.operators import trials as tl
from tunekit.operators.registry import METRIC, SELECTION, place_of
from tunekit.operators.space import Space
from tunekit.plans.chain import Chain
from tunekit.plans.generation import Outcome
from tunekit.sources.sinks import write_lines, write_table

REPORT_SCHEMA = "study_id bigint, rank int, op_idx int, op_name string, enabled boolean, key string, value double, text string"


def best_parameters(trials: DataFrame, space: Space, k: int = tl.BEST) -> DataFrame:
    """(study_id, rank, op_idx, op_name, enabled, key, value): the parameters of each study's k best trials.

    `enabled` is false for operators whose switch is off; key 'objective' closes a trial, with op_idx -1.
    """
    names = list(space.op_names) or [str(i) for i in range(len(space.ops))]
    cells, at = [], 0
    for op_idx, op in enumerate(space.ops):
        on = F.lit(True)
        gates = {p.needs[0] for p in op if p.needs and p.needs[0].endswith("on")}
        if gates:
            on = F.element_at("params", space.index(next(iter(gates))) + 1) >= 1.0
        for p in op:
            cells.append(_cell(op_idx, names[op_idx], on, p.name, F.element_at("params", at + 1)))
            at += 1
    cells.append(_cell(-1, "study", F.lit(True), "objective", F.col("objective")))
    rows = tl.top_trials(trials, k).select("study_id", "rank", F.explode(F.array(*cells)).alias("r"))
    return rows.select("study_id", "rank", "r.*")


def _cell(op_idx, name, on, key, value):
    return F.struct(
        F.lit(op_idx).alias("op_idx"), F.lit(name).alias("op_name"), on.alias("enabled"), F.lit(key).alias("key"), value.alias("value")
    )


def fitted_report(chain: Chain, marked: DataFrame, outcomes: Sequence[Outcome], path: str, study_id: int = 0) -> DataFrame:
    """Refit the transforms of the best chains, save each chain as a pipeline below `path`, and report on all of it.

    One row per constant: fitted values of the transforms, selected features, model folder, AUC pair, objective.
    The margin range of boosted trees is stored beside its model.
    """
    spark = marked.sparkSession
    rows: list[tuple] = []
    for rank, o in enumerate(outcomes, 1):
        if o.fit is None:
            continue
        prepared = chain.prepare(marked, o.params)
        try:
            fitted = iter(prepared.fitted)  # in the order of the chain
            for i, op in enumerate(chain.ops):
                base = (study_id, rank, i, op)
                if chain.is_transform(i):
                    _, f = next(fitted)
                    rows.append((*base, f.enabled, "on", float(f.enabled), None))
                    rows += [(*base, f.enabled, f"{c}.{k}", float(v), None) for c, k, v in f.constants]
                elif op == "evaluate":
                    rows += [(*base, True, f"{c}.corr", v, None) for c, v in prepared.evaluation]
                elif place_of(op) == SELECTION:
                    rows += [(*base, True, f"feature_{j}", None, n) for j, n in enumerate(o.names)]
                elif op == chain.trainer:
                    folder = f"{path}/model-{rank}"
                    chain.pipeline(prepared, o.fit).write().overwrite().save(folder)
                    rows.append((*base, True, "model", None, folder))
                    if o.fit.margins is not None:
                        rows += [(*base, True, k, float(v), None) for k, v in zip(("margin_low", "margin_high"), o.fit.margins)]
                elif place_of(op) == METRIC:
                    rows += [(*base, True, "train", o.train_value, None), (*base, True, "test", o.test_value, None)]
            rows.append((study_id, rank, -1, "study", True, "objective", o.objective, None))
        finally:
            prepared.release()
    report = spark.createDataFrame(rows, REPORT_SCHEMA)
    write_table(report, f"{path}/report")
    return spark.read.schema(report.schema).parquet(f"{path}/report")


def write_convergence(runs: DataFrame, trials: DataFrame, predicted: DataFrame, path: str) -> None:
    """Convergence table as parquet and, one line per study, as text."""
    write_table(runs, f"{path}/convergence")
    summary = tl.convergence_summary(runs).join(tl.accept_ratio(predicted), tl.STUDY)
    write_lines(tl.convergence_lines(summary, tl.best_sets(trials)), f"{path}/convergence_lines")


def load_chain(path: str) -> PipelineModel:
    return PipelineModel.load(path)
