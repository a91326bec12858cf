import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tunekit.catalog.views import FEATURES, KEYS, train_missing, train_outlier
from tunekit.operators import columns, select, split, surrogate, train, validate
from tunekit.operators import trials as tl
from tunekit.operators.space import chain_space
from tunekit.plans import report
from tunekit.plans.chain import Chain, start_params
from tunekit.plans.generation import run_candidates
from tunekit.plans.study import Limits, Study


@pytest.fixture(scope="module")
def prepared(spark, wide):
    df = split.k_fold(split.ab_split(wide, key=KEYS), 3, key=KEYS)
    df = columns.assemble(df, FEATURES, keep=["split", "fold"]).persist()
    df.count()
    return df


# ------------------------------------------------------------------ surrogates


@pytest.mark.parametrize("lam,elastic", [(0.1, 0.5), (0.0, 0.0), (0.02, 1.0), (0.05, 0.0)])
def test_linear_surrogate_equals_the_stock_regression(spark, lam, elastic):
    rng = random.Random(4)
    rows = []
    for study, n in ((1, 200), (2, 60)):
        for i in range(n):
            x = [rng.random() * 10, rng.gauss(3, 2), float(rng.randrange(2)), 5.0]
            rows.append((study, i, x, 0.3 * x[0] - 0.8 * x[1] + 0.5 * x[2] + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "study_id bigint, trial_id bigint, params array<double>, objective double")
    got = {r["study_id"]: r for r in surrogate.linear_surrogate(df, 4, lam, elastic).collect()}
    names = ["a", "b", "c", "d"]
    for study in (1, 2):
        one = df.filter(F.col("study_id") == study).select(*[F.col("params")[i].alias(n) for i, n in enumerate(names)], "objective")
        stock = LinearRegression(labelCol="objective", regParam=lam, elasticNetParam=elastic, maxIter=1000, tol=1e-12).fit(
            VectorAssembler(inputCols=names, outputCol="features").transform(one)
        )
        assert got[study]["coefs"] == pytest.approx(list(stock.coefficients), abs=1e-4)
        assert got[study]["intercept"] == pytest.approx(stock.intercept, abs=1e-3)
        assert sum(got[study]["importances"]) == pytest.approx(1.0)


def test_degenerate_studies_get_equal_importances(spark):
    rows = [(1, 0, [1.0, 2.0], 0.5), (2, 1, [1.0, 2.0], 0.7), (2, 2, [3.0, 2.0], 0.7)]
    df = spark.createDataFrame(rows, "study_id bigint, trial_id bigint, params array<double>, objective double")
    for r in surrogate.linear_surrogate(df, 2).collect():
        assert r["importances"] == [0.5, 0.5] and r["coefs"] == [0.0, 0.0]


def test_blended_surrogate(spark, log):
    df = log.withColumn("objective", F.col("params")[0] / 100.0 + F.col("params")[2] / 50.0)
    fitted = surrogate.fit_surrogate(df, 3, rounds=3)
    state = fitted.state.select("blend", "importances").collect()
    assert all(sum(r["blend"]) == pytest.approx(1.0) and min(r["blend"]) > 0 for r in state)
    assert all(sum(r["importances"]) == pytest.approx(1.0) for r in state)
    scored = fitted.predict(df)
    # the label and every other column stay, one prediction per row
    assert set(df.columns) < set(scored.columns) and scored.count() == df.count()
    assert scored.agg(F.avg(F.abs(F.col("prediction") - F.col("objective")))).first()[0] < 0.2


def test_accept_ratio_of_a_perfect_surrogate_is_zero(spark, log):
    rows = tl.accept_ratio(log.withColumn("prediction", F.col("objective"))).collect()
    assert rows and all(r["accept_ratio"] == 0.0 for r in rows)


# ------------------------------------------------------------------ selection and training


def test_lasso_keeps_all_or_the_strongest(spark, prepared):
    everything = select.lasso(prepared, 0.0)
    one = select.lasso(prepared, 100.0)
    assert everything.names == FEATURES and len(one.names) == 1
    assert columns.feature_names(one.transform(prepared)) == one.names


def test_threshold_falls_back_to_the_largest_absolute_coefficient(spark):
    df = spark.createDataFrame([(1, 0, -9e-7), (1, 1, 5e-7), (2, 0, 0.5), (2, 1, -0.1), (2, 2, 0.0)], "m int, idx int, coef double")
    got = {(r["m"], r["idx"]) for r in select.above_threshold(df, ["m"]).collect()}
    assert got == {(1, 0), (2, 0), (2, 1)}


def test_beam_counts_a_set_once(spark):
    rows = [("p", ["a", "b"], 0.9), ("q", ["b", "a"], 0.8), ("p", ["c"], 0.7), ("q", ["d"], 0.6), ("q", ["e"], 0.5)]
    df = spark.createDataFrame(rows, "parent string, fs array<string>, auc double").withColumn("g", F.lit(1))
    got = [tuple(r["fs"]) for r in select.beam_topk(df, ["g"], "parent", "fs", "auc", 2, 3).orderBy("rank").collect()]
    assert got == [("a", "b"), ("c",), ("d",)]


def test_backward_elimination_drops_noise(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        y = float(rng.random() < 0.5)
        rows.append((y, y + rng.gauss(0, 1.0), *[rng.gauss(0, 1) for _ in range(6)], i % 2))
    names = ["s", *[f"n{j}" for j in range(6)]]
    df = spark.createDataFrame(rows, "label double, " + ", ".join(f"{n} double" for n in names) + ", fold int")
    data = columns.assemble(df, names, keep=["fold"]).persist()
    found, gain, depth = select.backward_beam(data, max_depth=1)
    assert 1 <= len(found.names) < 7 and gain > 0 and depth >= 1
    assert "s" in found.names
    alone = columns.assemble(df, ["s"], keep=["fold"])
    kept, _, depth = select.backward_beam(alone)
    assert kept.names == ["s"] and depth == 0  # never empties the set


def test_gain_memory():
    assert select.depth_limit(1e-3, 0.99) == 1 and select.depth_limit(5e-3, 0.99) == 4
    assert select.remembered_gain(0.01, 0.0, 0) == 0.01
    assert select.remembered_gain(1.0, 0.0, 3) == pytest.approx(1 - select.GAIN_MEMORY)


@pytest.mark.parametrize(
    "name,params", [("lr", {"lam": 0.2}), ("rf", {"subset": 5, "ratio": 0.0, "trees": 5, "gini": 0}), ("gbt", {"iters": 3})]
)
def test_cross_validation(spark, prepared, name, params):
    pairs, final = train.cross_validate(prepared, train.TRAINERS[name](**params), k=3)
    rows = pairs.collect()
    assert sorted(r["fold"] for r in rows) == [train.FINAL, 0, 1, 2]
    assert all(r["test_value"] > 0.9 for r in rows)
    shares = train.importances(final, FEATURES)
    assert sum(v for _, v in shares) == pytest.approx(1.0) and max(shares, key=lambda t: t[1])[0] in ("l_quantity", "l_discount")
    if final.margins:
        assert final.margins[0] < final.margins[1]


def test_stacked_scores_hold_each_row_once_per_model(spark, prepared):
    rows = prepared.filter("split = 'A'")
    fits = train.fit_all(rows, [train.Job(7, f, train.logistic(0.2), [0, 2]) for f in (0, train.FINAL)])
    counts = {(r["fold"], r["split"]): r["count"] for r in train.stacked_scores(prepared, fits).groupBy("fold", "split").count().collect()}
    n_a, n_b = rows.count(), prepared.filter("split = 'B'").count()
    assert counts[(train.FINAL, "A")] == n_a and counts[(train.FINAL, "B")] == n_b
    assert counts[(0, "A")] + counts[(0, "B")] == n_a


def test_a_failed_job_does_not_stop_the_others(spark, prepared):
    jobs = [train.Job(0, train.FINAL, train.boosted(iters=1, bins=1)), train.Job(1, train.FINAL, train.logistic(0.2))]
    fits = train.fit_all(prepared, jobs)
    assert [f.trial_id for f in fits] == [1] and jobs[0].error and not jobs[1].error


def test_a_query_does_not_leave_out_a_failed_model(spark, prepared, sf_dir, monkeypatch):
    from tunekit.catalog import models

    with pytest.raises(RuntimeError, match="maxBins"):
        train.fit_every(prepared, [train.Job(0, train.FINAL, train.boosted(iters=1, bins=1)), train.Job(1, train.FINAL, train.logistic(0.2))])
    broken = train.boosted
    monkeypatch.setattr(train, "boosted", lambda: broken(iters=1, bins=1))
    with pytest.raises(RuntimeError, match="maxBins"):
        models.feature_importance(spark, sf_dir)


def test_a_search_does_not_pass_over_a_failed_fit(spark, prepared, monkeypatch):
    def fit_all(rows, jobs, parallelism=4):
        jobs[-1].error = "lost"
        return fit(rows, jobs[:-1], parallelism)

    fit = train.fit_all
    monkeypatch.setattr(train, "fit_all", fit_all)
    with pytest.raises(RuntimeError, match="lost"):
        select.backward_beam(prepared.filter("split = 'A'"), max_depth=1)


# ------------------------------------------------------------------ chains and studies


def test_chains_are_checked():
    for bad in (["assemble", "split", "lr", "auc"], ["split", "lr", "auc"], ["split", "assemble", "fill", "lr", "auc"], ["split", "minmax", "assemble", "lr", "auc"], ["split", "assemble", "auc"], ["split", "assemble", "lr"], ["split", "assemble", "what", "lr", "auc"], ["split", "assemble", "lasso", "minmax", "lr", "auc"]):
        with pytest.raises(ValueError):
            Chain(bad)


def test_start_point_of_the_default_chain():
    assert start_params(Chain()) == [1.0, 1e-3, 0.2]
    assert chain_space(Chain().ops).op_names == tuple(Chain().ops)


def test_long_chain_saved_and_loaded(spark, sf_dir, tmp_path):
    df = train_missing(spark, sf_dir)
    outliers = train_outlier(spark, sf_dir).select(*KEYS, F.col("l_extendedprice").alias("p"))
    df = df.drop("l_extendedprice").join(outliers.dropDuplicates(KEYS), KEYS).withColumnRenamed("p", "l_extendedprice")
    chain = Chain(("split", "balance", "evaluate", "fill", "clip", "power", "buckets", "assemble", "minmax", "rbf", "lasso", "gbt", "auc"), n_features=4, folds=2)
    params = [1.0, 1.0, 9.0, 1.0, 8.0, 1.0, 3.0, 1.0, 1.0, 4.0, 5.0, 2.0, 1e-4, 3.0, 32.0, 3.0, 1.0, 0.1, 1.0]
    assert len(params) == len(chain.space)
    marked = chain.marked(df, FEATURES, KEYS).persist()
    done = run_candidates(marked, chain, [(0, params)])
    assert done[0].error is None and done[0].test_value > 0.6
    table = report.fitted_report(chain, marked, done, str(tmp_path))
    keys = {(r["op_name"], r["key"]) for r in table.collect()}
    assert {("gbt", "margin_low"), ("auc", "test"), ("clip", "l_tax.q1"), ("rbf", "centre_0.radius"), ("study", "objective")} <= keys
    prepared = chain.prepare(marked, params)
    mine = train.with_outputs(prepared.table, [done[0].fit]).agg(F.sum("_o0").alias("s")).first()["s"]
    loaded = report.load_chain(f"{tmp_path}/model-1").transform(marked)
    theirs = loaded.agg(F.sum(vector_to_array("rawPrediction")[1]).alias("s")).first()["s"]
    assert theirs == pytest.approx(mine, rel=1e-6)
    prepared.release()


def test_trials_that_share_preparation_share_it(spark, wide):
    chain = Chain(n_features=4)
    assert chain.prep_key([1.0, 0.1, 0.2]) == chain.prep_key([1.0, 0.3, 0.4]) != chain.prep_key([0.0, 0.1, 0.2])


def test_caches_are_released(spark, wide):
    chain = Chain(("split", "assemble", "minmax", "lr", "auc"), n_features=4, folds=2)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run_candidates(chain.marked(wide, FEATURES, KEYS), chain, [(0, start_params(chain))])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_a_failed_candidate_is_a_row_with_an_error(spark, wide):
    chain = Chain(("split", "assemble", "minmax", "gbt", "auc"), n_features=4, folds=2)
    good = [1.0, 1.0, 32.0, 2.0, 1.0, 0.1, 1.0]
    bad = [1.0, 1.0, 1.0, 2.0, 1.0, 0.1, 1.0]  # one bin
    out = run_candidates(chain.marked(wide, FEATURES, KEYS), chain, [(0, bad), (1, good)])
    assert out[0].error and out[0].objective is None and out[1].error is None and out[1].test_value > 0.8


def test_study(spark, wide, tmp_path):
    chain = Chain(("split", "assemble", "minmax", "lr", "auc"), n_features=4, folds=2)
    study = Study(
        wide, FEATURES, chain, KEYS, slots=2, attempts=3, boost=False, limits=Limits(max_generations=2), log_path=str(tmp_path / "log")
    ).run()
    log = study.log().orderBy("trial_id").collect()
    assert study.generation == 2 and 3 <= len(log) <= 4
    assert {r["generation"] for r in log} == {0, 1} and all(r["objective"] > 0.9 for r in log)
    assert len({tuple(r["params"]) for r in log}) == len(log)
    summary = tl.convergence_summary(study.convergence()).first()
    assert summary["n_trials"] == len(log) and summary["stop_run"] is None
    assert study.best[0].objective == max(r["objective"] for r in log)
    predicted = study.trials().withColumn("prediction", F.col("objective"))
    report.write_convergence(study.convergence(), study.trials(), predicted, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out" / "convergence_lines")).collect()
    assert len(lines) == 1 and lines[0][0].split("\t")[0] == str(len(log))


def test_objective_needs_both_values(spark):
    df = spark.createDataFrame([(0, -1, 0.9, 0.8), (0, 0, 0.9, 0.7), (0, 1, 0.9, 0.9)], "trial_id bigint, fold int, train_value double, test_value double")
    r = train.trial_values(df).first()
    assert r["cv"] == pytest.approx(0.8) and r["final"] == 0.8 and r["objective"] == pytest.approx(0.8)
    gap = train.trial_values(df, "squared_gap").first()
    assert gap["final"] == pytest.approx(0.64 - 0.81)
    assert validate.OBJECTIVES.keys() == {"generalize", "squared_gap"}


def test_a_study_of_failing_trials_ends_and_names_the_cause(spark):
    rows = spark.createDataFrame([(float(i), float("nan"), float(i % 2)) for i in range(60)], "x double, broken double, label double")
    study = Study(rows, ["x", "broken"], Chain(("split", "assemble", "minmax", "lr", "auc"), folds=2), slots=2, limits=Limits(max_failed=2)).run()
    log = study.log().collect()
    assert study.generation == 2 and len(log) == 4
    assert all(r["objective"] is None and "SparkException" in r["error"] for r in log)


def test_bounds_come_from_the_data(spark):
    rows = spark.createDataFrame([(float(i), 1.0, float(i % 2)) for i in range(30)], "x double, y double, label double")
    chain = Chain(("split", "power", "assemble", "rbf", "lr", "auc"))
    params = {p.name: p for p in chain.bounded(rows, ["x", "y"]).space.params}
    assert params["power.code"].high == 33.0 and params["rbf.k"].high == 30.0


def test_a_study_leaves_only_its_log_behind(spark, tmp_path):
    from pathlib import Path

    from tunekit.sources.session import shared_folder

    rows = spark.range(80).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 2).cast("double").alias("label"))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    chain = Chain(("split", "assemble", "minmax", "lr", "auc"), folds=2)
    study = Study(rows, ["x", "y"], chain, slots=2, limits=Limits(max_generations=2), log_path=f"{tmp_path}/log", attempts=2).run()
    assert study.log().count() >= 3
    assert set(folder.iterdir()) == before


def test_an_operator_may_stand_twice_in_a_chain(spark):
    rows = spark.range(60).select((F.col("id") + 1).cast("double").alias("x"), (F.col("id") % 7 + 1).cast("double").alias("y"), (F.col("id") % 2).cast("double").alias("label"))
    chain = Chain(("split", "power", "power", "assemble", "minmax", "lr", "auc"), folds=2).bounded(rows, ["x", "y"])
    params = [1.0, 8.0, 1.0, 25.0, 1.0, 0.2]
    assert [chain.transform_for(i, params).code for i in (1, 2)] == [8, 25]
    marked = chain.marked(rows, ["x", "y"])
    prepared = chain.prepare(marked, params)
    # the transformed feature moves to the end, where the second code finds it
    assert prepared.names == ["y", "x_boxcox_8_boxcox_8"] and [op for op, _ in prepared.fitted] == ["power", "power", "minmax"]
    prepared.release()
    assert chain.prep_key(params) != chain.prep_key([*params[:3], 24.0, *params[4:]])
