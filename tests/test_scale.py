"""Steps that must not grow faster than their input: runs of scores, dealt gaps, grid probes, streamed surrogates."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector as as_vector
from pyspark.sql import functions as F

from tunekit.operators import boost, counted, surrogate, train, trials, validate


def brute(score, label, weight):
    pos, neg = [(s, w) for s, y, w in zip(score, label, weight) if y], [(s, w) for s, y, w in zip(score, label, weight) if not y]
    whole = sum(w for _, w in pos) * sum(w for _, w in neg)
    return sum(v * w * ((a > b) + (a == b) / 2) for a, v in pos for b, w in neg) / whole


@pytest.mark.parametrize("limit", [3, 10**6])
def test_runs_of_crowded_scores(spark, limit):
    r = np.random.default_rng(5)
    # most scores agree in far more than 20 leading bits; ties, infinities, both zeros
    score = [*(0.5 + r.integers(0, 40, 200) * 1e-13), *r.random(40), 0.0, -0.0, -1.5, float("inf"), float("-inf")]
    label, weight = r.integers(0, 2, len(score)).tolist(), r.integers(1, 4, len(score)).tolist()
    rows = [("a", float(s), float(y), float(w)) for s, y, w in zip(score, label, weight)] + [(None, 0.25, 1.0, 1.0), (None, 0.25, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, score double, label double, weight double").repartition(3)
    found = validate.auc_of_runs(validate._runs(df, ["g"], "score", "label", "weight"), ["g"], limit).collect()
    got = {x["g"]: x["auc"] for x in found}
    assert got["a"] == pytest.approx(brute(score, label, weight), abs=1e-12) and got[None] == 0.5


def test_scores_of_several_models_are_not_stacked(spark, wide):
    from tunekit.catalog.models import _prepared

    df = _prepared(spark, "/root/testdata/sf0.001").withColumn("fold", F.when(F.rand(3) < 0.9, F.col("fold")))
    df = df.withColumn("weight", F.col("label") + 1.0).persist()
    rows = df.filter(F.col("split") == "A")
    fits = train.fit_all(rows, [train.Job(4, 1, train.logistic(0.2)), train.Job(4, train.FINAL, train.boosted(iters=2)), train.Job(9, train.FINAL, train.logistic(0.0))])
    train.set_margin_ranges(rows, fits)
    pairs = train.validate_fits(df, fits)
    assert "Generate" not in pairs._jdf.queryExecution().toString()  # no row per model
    counts = validate.measures(train.stacked_scores(df, fits), ["trial_id", "fold", "split"], ["auc", "ks"], weight="weight")
    wanted = validate.train_test_pairs(counts.filter("metric = 'auc'"), ["trial_id", "fold"], "value")
    key = lambda x: (x["trial_id"], x["fold"])
    for a, b in zip(sorted(pairs.collect(), key=key), sorted(wanted.collect(), key=key), strict=True):
        assert key(a) == key(b) and tuple(a)[2:] == pytest.approx(tuple(b)[2:], abs=1e-12)
    df.unpersist()


def test_gaps_are_dealt_into_parts_by_the_rows(spark, log, monkeypatch):
    wanted = {r["study_id"]: r for r in trials.farthest_pairs(log).collect()}
    monkeypatch.setattr(trials, "GAP_ROWS", 20)
    found = trials.farthest_pairs(log)
    assert {r["study_id"]: r for r in found.collect()} == wanted
    assert found.rdd.getNumPartitions() >= log.count() // 20


def test_most_candidates_look_into_one_cell(spark, log):
    span = log.select(F.lit(1).alias("slot"), "params").withColumn("span", F.lit(500.0)).withColumn("norm", trials.arrays.norm(F.col("params")))
    assert trials._probes(span, trials.SAME).count() < 1.6 * span.count()


def test_near_duplicates_across_cell_borders(spark):
    past = [(1, 0, [0.0, 0.0]), (1, 1, [1000.0, 0.0])] + [(1, 2 + i, [1.0 + i * 0.0021, 5.0]) for i in range(300)]
    log = spark.createDataFrame(past, "study_id long, trial_id long, params array<double>")
    moved = log.filter("trial_id > 1")
    near = moved.select("study_id", F.col("trial_id").alias("slot"), F.transform("params", lambda x: x + 0.0004).alias("params"), F.lit(None).cast("array<double>").alias("parent"))
    far = near.withColumn("params", F.transform("params", lambda x: x + 0.01)).withColumn("slot", -F.col("slot"))
    hits = {r["slot"] for r in trials.near_duplicates(near.unionByName(far), log).collect()}
    assert {s for s in hits if s > 0} == set(range(2, 302)) and not {s for s in hits if s < 0}


def test_streamed_surrogate_equals_the_expression(spark, log):
    odd = log.select("study_id", "trial_id", "params", "objective").unionByName(
        spark.createDataFrame([(0, -1, [1.0, None, 2.0], 0.5), (0, -2, [float("nan"), 3.0, 2.0], 0.5), (-7, -3, [1.0, 1.0, 1.0], 0.5), (None, -4, [1.0, 1.0, 1.0], 0.5)], "study_id long, trial_id long, params array<double>, objective double")
    )
    fitted = surrogate.fit_surrogate(log, 3)
    got = fitted.predict(odd)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no trees beside the rows
    both = odd.join(fitted.state, "study_id").withColumn("_linear", surrogate.linear_prediction())
    both = both.withColumn("_boost", boost.boosted_prediction(F.col("trees"), F.col("params")))
    wanted = both.select("trial_id", surrogate.blended("blend", surrogate.LEARNERS).alias("prediction"))
    pick = lambda df: sorted(map(str, df.select("trial_id", "prediction").collect()))
    assert pick(got) == pick(wanted)


def test_a_table_with_splits_for_every_core_is_not_dealt_out(spark, tmp_path):
    from tunekit.catalog.views import train_wide

    cores = spark.sparkContext.defaultParallelism
    n = F.col("id")
    rows = spark.range(400).select(
        *[n.alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")], F.lit(1).alias("l_linenumber"),
        *[(n / 10.0).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/few/lineitem.parquet")
    rows.repartition(4 * cores).write.parquet(f"{tmp_path}/many/lineitem.parquet")
    few, many = (train_wide(spark, f"{tmp_path}/{d}") for d in ("few", "many"))
    exchange = lambda df: "RoundRobin" in df._jdf.queryExecution().toString()
    assert exchange(few) and not exchange(many)
    assert sorted(few.collect()) == sorted(many.collect())


def _few_valued(spark):
    from tunekit.catalog.models import _prepared

    df = _prepared(spark, "/root/testdata/sf0.001")
    return df.withColumn("weight", F.col("label") * 2.0 + 0.5 + F.col("fold") / 4.0).persist()


@pytest.mark.parametrize("weighed,indices", [(False, None), (True, [3, 0, 1])])
def test_trees_of_counted_cells_are_those_of_rows(spark, monkeypatch, weighed, indices):
    df = _few_valued(spark)
    df = df if weighed else df.drop("weight")
    rows = df.filter(F.col("split") == "A")
    jobs = lambda: [train.Job(0, fold, train.boosted(iters=4, bins=12, depth=4), indices) for fold in (0, train.FINAL)]
    whole = train.fit_every(rows, jobs())
    monkeypatch.setattr(counted, "LEAST_ROWS", 0)
    monkeypatch.setattr(counted, "GAIN", 0)
    cells = train.fit_every(rows, jobs())
    assert all(f.cuts is None for f in whole) and all(len(f.cuts) == len(indices or "four") for f in cells)
    train.set_margin_ranges(rows, whole)
    for a, b in zip(whole, cells):
        assert a.margins == pytest.approx(b.margins, abs=1e-9)
        assert dict(train.importances(a, "abcd")) == pytest.approx(dict(train.importances(b, "abcd")), abs=1e-9)
    both = train.with_outputs(df, [*whole, *cells]).select(*[F.max(F.abs(F.col(f"_o{i}") - F.col(f"_o{i + 2}"))) for i in range(2)]).first()
    assert max(both) < 1e-9
    train.set_margin_ranges(rows, cells)
    values = lambda fits: {r["fold"]: (r["train_value"], r["test_value"]) for r in train.validate_fits(df, fits).collect()}
    for fold, pair in values(whole).items():
        assert pair == pytest.approx(values(cells)[fold], abs=1e-9)
    df.unpersist()


def test_rows_that_no_model_tells_apart_are_scored_as_one(spark):
    rows = [(as_row, "A", 0, 1.0) for as_row in ([0.0, 1.0, 5.0], [0.2, 9.0, 5.0], [0.7, 2.0, 5.0], [0.7, 2.0, 6.5], [float("nan"), 2.0, 5.0])]
    df = spark.createDataFrame(rows, "x array<double>, split string, fold int, label double").select(as_vector("x").alias("features"), "split", "fold", "label")
    found = counted.alike(df, [([0], [[0.5]]), ([2, 0], [[6.0], [0.7]])], ["split", "fold", "label"]).collect()
    assert sorted(str((list(map(float, r["features"])), r["weight"])) for r in found) == sorted(
        str((v, n)) for v, n in [([0.0, 0.0, 5.0], 2.0), ([0.7, 0.0, 5.0], 1.0), ([0.7, 0.0, 6.5], 1.0), ([float("nan"), 0.0, 5.0], 1.0)]
    )


def test_rows_of_one_cell_are_fitted_as_one(spark, monkeypatch):
    n = F.col("id")
    rows = spark.range(40_000).select(
        F.array((n % 5).cast("double"), (n % 7).cast("double")).alias("x"), ((n % 5) * (n % 7) + n % 3 > 9).cast("double").alias("label"), F.lit("A").alias("split"), (n % 3).cast("int").alias("fold")
    )
    rows = rows.select(as_vector(F.col("x")).alias("features"), "label", "split", "fold").persist()
    seen = []
    fit = train.GBTClassifier.fit
    monkeypatch.setattr(train.GBTClassifier, "fit", lambda self, df, *a: seen.append(df.count()) or fit(self, df, *a))
    fits = train.fit_every(rows, [train.Job(0, f, train.boosted(iters=2)) for f in (0, train.FINAL)], parallelism=1)
    assert len(seen) == 2 and max(seen) <= 70 and all(f.cuts for f in fits)
    # what limits rows, or draws them, is fitted on rows
    train.fit_every(rows, [train.Job(0, train.FINAL, train.boosted(iters=1, min_rows=2)), train.Job(0, train.FINAL, train.boosted(iters=1, sample=0.5))], parallelism=1)
    assert seen[2:] == [40_000, 40_000]
    rows.unpersist()


def test_thresholds_of_many_values():
    values = np.array([0.0] * 50 + [1.0] * 10 + [2.0] * 10 + [3.0] * 20 + [4.0] * 10)
    assert counted.thresholds(values, np.ones(100), 4) == [0.5, 1.5, 2.5, 3.5]
    assert counted.thresholds(values, np.ones(100), 3) == [0.5, 1.5, 2.5] and counted.thresholds(values, np.ones(100), 1) == [0.5]


def test_a_fit_on_cells_refuses_what_one_on_rows_refuses(spark, monkeypatch):
    monkeypatch.setattr(counted, "LEAST_ROWS", 0)
    monkeypatch.setattr(counted, "GAIN", 0)
    n = F.col("id")
    rows = spark.range(400).select((n % 4).cast("double").alias("a"), (n % 3 > 0).cast("double").alias("label"), F.lit("A").alias("split"), F.lit(0).alias("fold"), F.lit(1.0).alias("weight"))
    odd = F.when(n == 7, F.lit(float("nan")))
    for column, value in (("a", odd.otherwise(n % 4)), ("a", F.when(n == 7, F.lit(float("inf"))).otherwise(n % 4)), ("weight", F.when(n == 7, -1.0).otherwise(1.0)), ("weight", odd.otherwise(1.0)), ("label", F.when(n != 7, 1.0))):
        bad = spark.range(400).select((n % 4).cast("double").alias("a"), (n % 3 > 0).cast("double").alias("label"), F.lit("A").alias("split"), F.lit(0).alias("fold"), F.lit(1.0).alias("weight"), value.cast("double").alias("_new"))
        bad = bad.withColumn(column, F.col("_new")).select(as_vector(F.array("a")).alias("features"), "label", "split", "fold", "weight")
        job = train.Job(0, train.FINAL, train.boosted(iters=1))
        assert train.fit_all(bad, [job]) == [] and job.error
    assert train.fit_every(rows.withColumn("features", as_vector(F.array("a"))), [train.Job(0, train.FINAL, train.boosted(iters=1))])[0].cuts == [[0.5, 1.5, 2.5]]


def test_a_saved_chain_codes_what_its_trees_read(spark, wide, tmp_path, monkeypatch):
    from tunekit.catalog.views import FEATURES, KEYS
    from tunekit.plans import report
    from tunekit.plans.chain import Chain
    from tunekit.plans.generation import run_candidates

    monkeypatch.setattr(counted, "LEAST_ROWS", 0)
    monkeypatch.setattr(counted, "GAIN", 0)
    chain = Chain(("split", "assemble", "minmax", "lasso", "gbt", "auc"), n_features=4, folds=2)
    params = [1.0, 1e-3, 3.0, 32.0, 3.0, 1.0, 0.1, 1.0]
    marked = chain.marked(wide, FEATURES, KEYS)
    done = run_candidates(marked, chain, [(0, params)])[0]
    assert done.error is None and done.fit.cuts is not None
    prepared = chain.prepare(marked, params)
    chain.pipeline(prepared, done.fit).write().save(f"{tmp_path}/chain")
    mine = train.with_outputs(prepared.table, [done.fit]).select(train.positive_score(done.fit, F.col("_o0")).alias("s"))
    theirs = report.load_chain(f"{tmp_path}/chain").transform(marked).select(F.col(train.POSITIVE).alias("s"))
    counts = [{round(r["s"], 9): r["n"] for r in d.groupBy("s").agg(F.count("s").alias("n")).collect()} for d in (mine, theirs)]
    assert counts[0] == counts[1] and len(counts[0]) > 3
    prepared.release()


def test_written_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from tunekit.sources import session

    monkeypatch.setattr(session, "HELD_ROWS", 100)
    one = F.lit(1).alias("n")
    side = spark.range(5000).select("id", one)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for rows, name in ((50, "Broadcast"), (500, "SortMerge")):
        table = session.through_table(spark.range(rows).select("id"), "numbers", merged=True)
        assert table.count() == rows and f"{name}" in plan(side.join(table.where("id > 3").distinct(), "id"))
    assert session.through_table(spark.range(9).where("false"), "numbers", merged=True).count() == 0
    assert session.through_table(spark.createDataFrame([], "id long"), "numbers", merged=True).count() == 0


def test_no_generation_holds_its_slots_or_the_log(spark, log, monkeypatch):
    from tunekit.catalog.log import SPACE
    from tunekit.plans.generation import next_candidates
    from tunekit.sources import session

    fitted = surrogate.fit_surrogate(log, 3)
    pick = lambda df: sorted(map(str, df.collect()))
    wanted = pick(next_candidates(log, SPACE, surrogate=fitted))
    monkeypatch.setattr(session, "HELD_ROWS", 0)
    plans = []
    write = session.through_table

    def noted(df, name, merged=False):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, merged)

    from tunekit.plans import generation

    monkeypatch.setattr(generation, "through_table", noted)
    assert pick(next_candidates(log, SPACE, surrogate=fitted)) == wanted
    for name, plan in plans:
        if name in ("states", "proposals"):
            assert not [line for line in plan.split("\n") if "BroadcastExchange" in line and "slot" in line], (name, plan)
    near = trials.near_duplicates(log.select("study_id", F.lit(1).alias("slot"), "params", F.lit(None).cast("array<double>").alias("parent")), log)
    assert "SortMergeJoin" in near._jdf.queryExecution().executedPlan().toString()
