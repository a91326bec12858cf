"""Boosted surrogates, shared preparation, the extension surface, objectives of several metrics and weights."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tunekit.catalog.views import FEATURES, KEYS, train_missing
from tunekit.operators import boost, registry, split, surrogate, train, validate
from tunekit.operators.prep import MinMax
from tunekit.operators.prep.base import FittedColumns, Prep
from tunekit.operators.registry import METRIC, TRAINER, WIDE, Operator
from tunekit.operators.space import Param
from tunekit.plans import report
from tunekit.plans.chain import Chain, start_params
from tunekit.plans.generation import run_candidates, walk
from tunekit.plans.study import Limits, Study

# ------------------------------------------------------------------ boosted surrogates


def plain_boosting(rows, cuts, rounds, depth, step):
    """Boosting of one study row by row: trees as nested tuples (feature, threshold, left, right) or a leaf value."""
    d = len(cuts)

    def grow(items, level):
        total = sum(r for _, r in items)
        best = None
        if level < depth:
            for f in range(d):
                for t in cuts[f]:
                    left = [r for x, r in items if x[f] <= t]
                    if 0 < len(left) < len(items):
                        s, n, m = sum(left), len(left), len(items)
                        gain = s * s / n + (total - s) ** 2 / (m - n) - total * total / m
                        if gain > (total * total / m + 1.0) * 1e-12 and (best is None or round(gain, 9) > best[0]):
                            best = (round(gain, 9), f, t)
        if best is None:
            return total / len(items)
        _, f, t = best
        return (f, t, grow([i for i in items if i[0][f] <= t], level + 1), grow([i for i in items if i[0][f] > t], level + 1))

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    reached = [0.0] * len(rows)
    for turn in range(rounds):
        residual = [y if turn == 0 else 2 * (y - r) for (_, y), r in zip(rows, reached)]
        tree = grow([(x, r) for (x, _), r in zip(rows, residual)], 0)
        reached = [r + value(tree, x) * (1.0 if turn == 0 else step) for (x, _), r in zip(rows, reached)]
    return reached


@pytest.fixture(scope="module")
def studies(spark):
    rng = random.Random(5)
    rows = []
    for study, n in ((1, 1), (2, 2), (3, 40), (4, 150), (5, 30), (6, 25)):
        for i in range(n):
            x = [rng.choice([0.0, 1.0, 2.0]), rng.random() * 10, 7.0]
            y = 0.3 if study == 5 else (x[1] > 4) * 2.0 + (0.5 * x[0] if study == 4 else 0.0) + rng.gauss(0, 0.1)
            rows.append((study, i, x, y))
    rows += rows[60:80] + [(6, 99, [1.0, 1.0, 7.0], None)]
    return rows, spark.createDataFrame(rows, "study_id long, trial_id long, params array<double>, objective double")


@pytest.mark.parametrize("local", [boost.LOCAL_CELLS, 0, 30])
def test_boosted_surrogates_against_plain_boosting(spark, studies, local):
    rows, df = studies
    kw = {"rounds": 3, "depth": 2, "codes": 8}
    found = boost.boosted_surrogates(df, 3, local_cells=local, **kw)
    cuts = {r["study_id"]: r["cuts"] for r in boost.quantile_cuts(df.where("objective is not null"), 3, 8).collect()}
    scored = df.join(found, "study_id").select("study_id", "params", boost.boosted_prediction(F.col("trees"), F.col("params"), 2).alias("p"))
    got = {(r["study_id"], tuple(r["params"])): r["p"] for r in scored.collect()}
    for study in range(1, 7):
        own = [(x, y) for s, _, x, y in rows if s == study and y is not None]
        for (x, _), p in zip(own, plain_boosting(own, cuts[study], 3, 2, boost.STEP)):
            assert got[(study, tuple(x))] == pytest.approx(p, abs=1e-9)
    shares = {r["study_id"]: r["tree_importances"] for r in found.collect()}
    assert all(sum(s) == pytest.approx(1.0) for s in shares.values())
    assert shares[5] == pytest.approx([1 / 3] * 3) and shares[1] == pytest.approx([1 / 3] * 3)
    assert shares[3][1] > 0.7 and shares[4][0] > 0.02 and abs(shares[3][1] - shares[4][1]) > 1e-3  # importances are those of the study
    assert boost.boosted_surrogates(df.limit(0), 3, **kw).count() == 0


def test_each_study_has_a_surrogate_of_its_own(spark, studies):
    _, df = studies
    alone = surrogate.fit_surrogate(df.where("study_id = 4"), 3, rounds=3)
    both = surrogate.fit_surrogate(df, 3, rounds=3)
    a = alone.predict(df.where("study_id = 4")).agg(F.sum("prediction")).first()[0]
    b = both.predict(df).where("study_id = 4").agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b, rel=1e-9)


# ------------------------------------------------------------------ shared preparation


def test_candidates_fit_what_they_share_once(spark, sf_dir, monkeypatch):
    chain = Chain(("split", "fill", "assemble", "minmax", "standardize", "lr", "auc"), n_features=4, folds=2)
    marked = chain.marked(train_missing(spark, sf_dir), FEATURES, KEYS)
    vectors = {5: [0.0, 1.0, 1.0, 0.2], 6: [0.0, 1.0, 0.0, 0.2], 7: [0.0, 0.0, 1.0, 0.2], 8: [0.0, 1.0, 1.0, 0.9]}
    fits = []
    for cls in (Prep,):
        plain = cls._fit
        monkeypatch.setattr(cls, "_fit", lambda self, rows, plain=plain: (fits.append(type(self).__name__), plain(self, rows))[1])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    seen = []
    for prepared, members in walk(chain, marked, vectors, lambda m, e: pytest.fail(str(e))):
        alone = chain.prepare(marked, vectors[members[0]])
        same = [f.constants for _, f in prepared.fitted] == [f.constants for _, f in alone.fitted]
        sums = [p.table.select(F.sum(F.xxhash64("features", "label", "split", "fold").cast("decimal(38,0)"))).first()[0] for p in (prepared, alone)]
        seen.append((members, same, sums[0] == sums[1]))
        prepared.release()
        alone.release()
    shared = len(fits) - 3 * len(seen)
    assert shared == 1 + 2 + 3  # one fill, two min-max settings, three standardisations
    assert sorted(m for members, _, _ in seen for m in members) == [5, 6, 7, 8] and [5, 8] in [m for m, _, _ in seen]
    assert all(a and b for _, a, b in seen)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_a_transform_that_fails_takes_only_its_own_branch(spark, wide):
    def build(values, chain):
        if values[0] == 1.0:
            raise ValueError("broken on purpose")
        return MinMax()

    registry.register(Operator("fragile", registry.VECTOR, build, lambda n, rows: (Param("fragile.on", 0.0, 0.0, 1.0, 1.0),)))
    try:
        chain = Chain(("split", "assemble", "fragile", "lr", "auc"), n_features=4, folds=2)
        out = run_candidates(chain.marked(wide, FEATURES, KEYS), chain, [(0, [1.0, 0.2]), (1, [0.0, 0.2])])
    finally:
        registry.unregister("fragile")
    assert "broken on purpose" in out[0].error and out[1].error is None and out[1].objective > 0.9


# ------------------------------------------------------------------ the extension surface


class Halved(Prep):
    """A transform from outside: every column times a factor."""

    def __init__(self, factor, **kw):
        super().__init__(**kw)
        self.factor = factor

    def fit_rows(self, df):
        names = self.inputs(df)
        return FittedColumns(names, [(c, "factor", self.factor) for c in names], replaced={c: f"`{c}` * {self.factor}D" for c in names})


def accuracy(scores, keys, weight=None):
    hit = (F.col("score") >= 0.5) == (F.col("label") > 0.5)
    return scores.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("value"))


def test_own_transform_trainer_and_metric_in_a_study(spark, wide, tmp_path):
    own = [
        Operator("halved", WIDE, lambda v, chain: Halved(v[0]), lambda n, rows: (Param("halved.factor", 0.5, 0.1, 2.0, 0.1),)),
        Operator(
            "ridge", TRAINER, lambda v, chain: LogisticRegression(regParam=v[0], maxIter=20), lambda n, rows: (Param("ridge.lambda", 0.1, 0.0, 1.0, 0.05),)
        ),
        Operator("accuracy", METRIC, accuracy),
    ]
    for op in own:
        registry.register(op)
    try:
        chain = Chain(("split", "halved", "assemble", "minmax", "ridge", "accuracy", "auc"), folds=2)
        assert start_params(chain) == [0.5, 1.0, 0.1] and chain.metrics == ["accuracy", "auc"]
        goal = validate.Objective(fold={"accuracy": (0, 0, 0, 0, 1.0)}, final={"accuracy": (0, 0, 0, 0, 1.0), "ks": (0, 0, 0, 0, 0.5)})
        study = Study(
            wide, FEATURES, chain, KEYS, slots=2, preset=goal, attempts=2, boost=False, limits=Limits(max_generations=2), log_path=str(tmp_path / "log")
        ).run()
        log = study.log().collect()
        assert len(log) >= 3 and all(r["error"] is None and 1.0 < r["objective"] < 1.5 for r in log)
        assert all(0.8 < r["test_value"] <= 1.0 for r in log)
        table = report.fitted_report(chain, study.marked, study.best[:1], str(tmp_path / "out")).collect()
        keys = {(r["op_name"], r["key"]) for r in table}
        assert {("halved", "l_tax.factor"), ("ridge", "model"), ("accuracy", "test")} <= keys
        loaded = report.load_chain(f"{tmp_path}/out/model-1").transform(study.marked)
        assert loaded.select("prediction").distinct().count() == 2
        with pytest.raises(ValueError):
            registry.register(own[0])
    finally:
        for op in own:
            registry.unregister(op.name)
    with pytest.raises(ValueError):
        Chain(("split", "halved", "assemble", "lr", "auc"))


def test_spaces_that_depend_on_data_must_be_bounded():
    with pytest.raises(ValueError):
        Chain(("split", "power", "assemble", "lr", "auc")).space  # noqa: B018
    assert Chain(("split", "assemble", "rbf", "lr", "auc"), n_features=3).space.params[1].high == float("inf")


# ------------------------------------------------------------------ objectives and weights


def test_measures_agree_with_the_single_metrics(spark):
    rng = random.Random(2)
    rows = [(t, rng.choice([0.1, 0.5, rng.random()]), float(rng.random() < 0.4), rng.choice([0.5, 1.0, 3.0])) for t in (1, 2) for _ in range(300)]
    rows += [(3, 0.5, 1.0, 1.0), (4, 0.1, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "t int, score double, label double, w double")
    names = ["ks", "auc", "sensitivity@0.5", "f1@0.3", "specificity@0.5", "precision@0.3"]
    got = {(r["t"], r["metric"]): r["value"] for r in validate.measures(df, ["t"], names).collect()}
    for r in validate.auc(df, ["t"]).collect():
        assert got[(r["t"], "auc")] == pytest.approx(r["auc"])
    for r in validate.ks(df, ["t"]).collect():
        assert got[(r["t"], "ks")] == pytest.approx(r["ks"])
    for r in validate.threshold_metrics(df, ["t"], [0.3, 0.5]).collect():
        for kind in validate.RATES:
            if (r["t"], f"{kind}@{r['threshold']}") in got:
                assert got[(r["t"], f"{kind}@{r['threshold']}")] == pytest.approx(r[kind])
    with pytest.raises(ValueError):
        validate.measures(df, ["t"], ["auc", "sense"])
    # a weight of 3 is three rows
    thrice = df.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("w") * 2).cast("int"))))
    plain = {(r["t"], r["metric"]): r["value"] for r in validate.measures(thrice, ["t"], names).collect()}
    weighed = {(r["t"], r["metric"]): r["value"] for r in validate.measures(df, ["t"], names, weight="w").collect()}
    assert weighed == pytest.approx(plain)


def test_weights_reach_the_fit(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(1.0 if i % 10 == 0 else 0.0, 1.0), float(i % 10 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "x double, label double")
    plain, weighed = (Chain(("split", *ops, "assemble", "lr", "auc"), n_features=1, folds=2) for ops in ((), ("weigh",)))
    shares = []
    for chain in (plain, weighed):
        prepared = chain.prepare(chain.marked(df, ["x"]), [0.0])
        fit = train.fit_all(prepared.table.where("split = 'A'"), [train.Job(0, train.FINAL, chain.estimator([0.0]))])[0]
        scored = train.stacked_scores(prepared.table, [fit])
        assert ("weight" in scored.columns) == (chain is weighed)
        shares.append(scored.where("split = 'A'").agg(F.avg("score")).first()[0])
        prepared.release()
    assert shares[0] == pytest.approx(0.1, abs=0.03) and shares[1] > 0.3  # balanced classes move the scores
    out = run_candidates(weighed.marked(df, ["x"]), weighed, [(0, [0.0])])
    assert out[0].error is None and out[0].objective > 0.6


def test_labels_must_be_binary(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "label double")
    for fn in (split.class_weights, split.downsample):
        with pytest.raises(ValueError):
            fn(df)


def test_saved_boosted_chain_scores_as_in_training(spark, wide, tmp_path):
    chain = Chain(("split", "assemble", "minmax", "gbt", "auc"), n_features=4, folds=2)
    params = [1.0, 3.0, 32.0, 2.0, 1.0, 0.1, 1.0]
    marked = chain.marked(wide, FEATURES, KEYS)
    done = run_candidates(marked, chain, [(0, params)])[0]
    prepared = chain.prepare(marked, params)
    chain.pipeline(prepared, done.fit).write().save(f"{tmp_path}/chain")
    mine = train.with_outputs(prepared.table, [done.fit]).select(train.positive_score(done.fit, F.col("_o0")).alias("s"))
    theirs = report.load_chain(f"{tmp_path}/chain").transform(marked).select(F.col(train.POSITIVE).alias("s"))
    counts = [{round(r["s"], 9): r["n"] for r in d.groupBy("s").agg(F.count("s").alias("n")).collect()} for d in (mine, theirs)]
    assert counts[0] == counts[1] and len(counts[0]) > 3
    prepared.release()


def test_importances_do_not_depend_on_units(spark, wide):
    chain = Chain(("split", "assemble", "lr", "auc"), n_features=4, folds=2)
    scaled = wide.withColumn("l_extendedprice", F.col("l_extendedprice") / 1000.0)
    found = []
    for df in (wide, scaled):
        prepared = chain.prepare(chain.marked(df, FEATURES, KEYS), [0.0])
        rows = prepared.table.where("split = 'A'")
        fit = train.fit_all(rows, [train.Job(0, train.FINAL, chain.estimator([0.0]))])[0]
        found.append(dict(train.importances(fit, FEATURES, rows)))
        prepared.release()
    assert found[0] == pytest.approx(found[1], rel=1e-3)


# ------------------------------------------------------------------ study states


def plain_states(trials, n):
    from tunekit.operators.state import study_states

    return {r["study_id"]: r.asDict(recursive=True) for r in study_states(trials, n, gaps=False).collect()}


def test_states_merge_in_any_order(spark, log):
    from tunekit.operators.state import merged, study_states

    parts = [log.where(F.pmod(F.xxhash64("trial_id"), F.lit(3)) == i) for i in range(3)]
    a, b, c = (study_states(p, 3, gaps=False) for p in parts)
    whole = plain_states(log, 3)
    for order in ((merged(merged(a, b), c)), merged(c, merged(b, a)), merged(merged(c, a), b)):
        assert {r["study_id"]: r.asDict(recursive=True) for r in order.collect()} == whole
    assert {r["study_id"]: r.asDict(recursive=True) for r in merged(a, a.limit(0)).collect()} == plain_states(parts[0], 3)


def test_states_go_on_without_the_log(spark, log):
    from tunekit.operators import trials as tl
    from tunekit.operators.state import advanced, study_states, with_steady

    cut = log.withColumn("rn", F.expr("row_number() over (partition by study_id order by ts, trial_id)"))
    early, late = cut.where("rn <= 40").drop("rn"), cut.where("rn > 40").drop("rn")
    state = with_steady(study_states(early, 3, gaps=False), tl.convergence(early))
    got = advanced(state, late, 3)
    expected = with_steady(study_states(log, 3, gaps=False), tl.convergence(log))
    columns = expected.columns
    rows = lambda d: sorted(map(str, d.select(*columns).collect()))
    assert rows(got) == rows(expected)


def test_gaps_of_a_state_are_those_of_the_log(spark, log):
    from tunekit.operators import trials as tl
    from tunekit.operators.state import study_states

    state = {r["study_id"]: r for r in study_states(log, 3).collect()}
    for at in range(3):
        values = log.select("study_id", "trial_id", F.col("params")[at].alias("v"))
        for r in tl.largest_gap(values, ["study_id"], "v", "trial_id").collect():
            g = state[r["study_id"]]["gaps"][at]
            assert (g["balanced"], g["low"], g["high"], g["lower"], g["upper"]) == (r["balanced"], r["low"], r["high"], r["lower"]["v"], r["upper"]["v"])
    for r in tl.farthest_pairs(log).collect():
        pair = state[r["study_id"]]["pair"]
        assert (pair["first"]["trial_id"], pair["second"]["trial_id"]) == (r["lower"]["id"], r["upper"]["id"])
        assert pair["first"]["params"] == r["lower"]["payload"]["params"] and pair["second"]["objective"] == r["upper"]["payload"]["objective"]


def test_a_study_never_draws_a_spent_strategy(spark):
    from tunekit.operators import propose as pr
    from tunekit.operators.space import INT, Space
    from tunekit.operators.state import spent, study_states

    space = Space(((Param("a", 1.0, 0.0, 3.0, 1.0, INT),),))
    rows = [(1, i, "2024-01-01 00:00:00", "gap", [float(i % 4)], 0.1 * i) for i in range(8)]
    rows += [(2, i, "2024-01-01 00:00:00", "gap", [float(i % 2)], 0.1 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "study_id long, trial_id long, ts string, strategy string, params array<double>, objective double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    base = study_states(df, 1)
    alive = base.select("study_id", spent(base, pr.STRATEGIES, space.array("low"), space.array("high")).alias("alive"))
    table = pr.strategy_table(base.select("study_id"), pr.rewards(df)).join(alive, "study_id")
    drawn = {(r["study_id"], r["strategy"]) for r in pr.pick_strategy(table, 300).collect()}
    assert not {(1, "gap"), (1, "expand"), (1, "crossover"), (2, "crossover")} & drawn
    assert {(2, "expand"), (1, "mutation"), (2, "mutation")} <= drawn
