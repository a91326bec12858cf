"""The trial log and the proposals against plain Python, on small logs cut into many chunks."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tunekit.catalog.log import SPACE
from tunekit.functions import arrays, scan
from tunekit.functions.draws import normal, uniform, uniform_fast
from tunekit.operators import propose as pr
from tunekit.operators import trials as tl
from tunekit.operators.prep import clip_method_index
from tunekit.operators.space import BOOLEAN, INT, Param, Space, chain_space
from tunekit.operators.surrogate import fit_surrogate
from tunekit.plans.generation import next_candidates

LOG = "study_id bigint, trial_id bigint, ts timestamp_ntz, strategy string, params array<double>, objective double"
START = dt.datetime(2024, 1, 1)


def make_log(spark, sizes, seed=3, crowd=False, dims=3):
    rng = random.Random(seed)
    rows, t = [], 0
    for study, n in sizes.items():
        for i in range(n):
            at = START + dt.timedelta(seconds=(i if not crowd else (i * i * i) // 50))
            params = [float(rng.randrange(20)) if d == 0 else rng.random() * 10 for d in range(dims)]
            rows.append((study, t, at, rng.choice(["a", "b"]), params, rng.random() ** 8))
            t += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, LOG)


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Cut every group into chunks of about 7 rows."""
    small = lambda df, keys, order, rows=7: scan.with_chunks(df, keys, order, rows)
    monkeypatch.setattr(tl, "with_chunks", small)
    monkeypatch.setattr(pr, "with_chunks", small)


def brute_convergence(rows, tol, max_steady, min_trials, max_trials):
    out, best, steady = {}, None, 0
    for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1):
        now = r[5] if best is None else max(best, r[5])
        steady = 0 if now - (best or 0.0) > tol else steady + 1
        best = now
        out[r[1]] = (i, best, steady, i > min_trials and (i > max_trials or steady > max_steady))
    return out


@pytest.mark.parametrize("crowd", [False, True])
def test_convergence_over_chunks(spark, tiny_chunks, crowd):
    rows, df = make_log(spark, {1: 90, 2: 5, 3: 1}, crowd=crowd)
    got = {(r["study_id"], r["trial_id"]): tuple(r)[2:] for r in tl.convergence(df, 1e-4, 10, 20, 60).collect()}
    for study in (1, 2, 3):
        want = brute_convergence([r for r in rows if r[0] == study], 1e-4, 10, 20, 60)
        assert {t: v for (s, t), v in got.items() if s == study} == want


def test_chunks_keep_order_and_size(spark):
    df = spark.range(10000).select(F.lit(1).alias("g"), "id")
    cut = scan.with_chunks(df, ["g"], F.col("id"), rows=100)
    sizes = cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("chunk").collect()
    assert len(sizes) == 100 and max(r["n"] for r in sizes) <= 101
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]))


def test_crowded_chunks_are_cut_again(spark):
    # nearly all rows within a thousandth of the range
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.col("id") / 2e7).alias("x")).union(spark.sql("SELECT 1, 1D"))
    cut = scan.with_chunks(df, ["g"], F.col("x"), rows=1000)
    assert cut.groupBy("chunk", "chunk2").count().count() > cut.groupBy("chunk").count().count()


def test_running_sums_and_totals(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 7 - 3).cast("double").alias("v"))
    cut = scan.with_chunks(df, ["g"], F.col("id"), rows=13)
    got = scan.running(cut, ["g"], ["id"], {"s": (F.col("v"), "sum"), "b": (F.col("v"), "sum", False), "m": (F.col("v"), "max")}).collect()
    for g in (0, 1):
        run, top = 0.0, -math.inf
        part = sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])
        for i, r in enumerate(part):
            assert r["b"] == (None if i == 0 else run)
            run, top = run + r["v"], max(top, r["v"])
            assert (r["s"], r["m"]) == (run, top)
        assert {r["s_all"] for r in part} == {run}


def test_rewards_over_chunks(spark, tiny_chunks):
    rows, df = make_log(spark, {1: 80, 2: 3})
    got = {(r["study_id"], r["strategy"]): r["reward"] for r in pr.rewards(df).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        key = (r[0], r[3])
        want[key] = 0.8 * want.get(key, 1.0) + 0.2 * r[5]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def brute_gap(values):
    n = len(values)
    lo, hi = min(values), max(values)
    if n == 1 or lo == hi:
        return True, lo, lo
    buckets = {}
    for v in values:
        buckets.setdefault(min(int((v - lo) * n / (hi - lo)), n - 1), []).append(v)
    keys = sorted(buckets)
    if len(keys) == n:
        gaps = [(buckets[b][0] - buckets[a][0], -b, a, b) for a, b in zip(keys, keys[1:])]
        _, _, a, b = max(gaps)
        return True, buckets[a][0], buckets[b][0]
    _, b, a = max((b - a, b, a) for a, b in zip(keys, keys[1:]))
    return False, max(buckets[a]), min(buckets[b])


@pytest.mark.parametrize("kind", ["random", "even", "clustered", "constant", "single"])
def test_largest_gap(spark, kind):
    rng = random.Random(9)
    values = {
        "random": [rng.random() for _ in range(200)],
        "even": [float(i) + 0.3 * (i % 3) for i in range(100)],
        "clustered": [rng.gauss(c, 0.1) for c in (0, 5, 50) for _ in range(60)],
        "constant": [4.0] * 9,
        "single": [2.5],
    }[kind]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "study_id int, trial_id bigint, v double")
    r = tl.largest_gap(df, ["study_id"], "v", "trial_id").first()
    assert (r["balanced"], r["lower"]["v"], r["upper"]["v"]) == brute_gap(values)


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    rows, df = make_log(spark, {1: 60, 2: 40})
    # a hot vector: a third of study 1 repeats it
    hot = [3.0, 4.0, 5.0]
    rows += [(1, 1000 + i, START, "a", hot, 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, LOG)
    cand = []
    for slot in range(80):
        s, _, _, _, p, _ = rng.choice(rows)
        shift = rng.choice([0.0, 1e-9, 1e-7, 3e-6, 1e-5, 1e-4, 0.5])
        q = [p[0], p[1] + shift, p[2]]
        cand.append((s, slot, q, rng.choice([None, p, [0.0, 0.0, 0.0]])))
    c = spark.createDataFrame(cand, "study_id bigint, slot int, params array<double>, parent array<double>")
    got = {r["slot"] for r in tl.near_duplicates(c, df, eps=1e-6).collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = set()
    for s, slot, q, parent in cand:
        mine = [r[4] for r in rows if r[0] == s]
        span = max(map(norm, mine)) - min(map(norm, mine))
        for p in mine:
            near = abs(norm(p) - norm(q)) / span < 1e-6 and math.dist(p, q) / span < 1e-6
            if near and (parent is None or math.dist(p, parent) / span >= 1e-6):
                want.add(slot)
    assert got == want and 0 < len(want) < 80


def test_top_trials_are_limited_before_the_shuffle(spark, log):
    plan = tl.top_trials(log)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_roulette_tables_never_pick_zero(spark, tiny_chunks):
    rows = [(g, i, float(i % 3)) for g in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, w double")
    picked = pr.roulette_pick(df, ["g"], "w", "i", uniform(["g"], "t")).collect()
    assert len(picked) == 40 and all(r["i"] % 3 > 0 for r in picked)


def test_roulette_index(spark):
    df = spark.createDataFrame([(0.01,), (0.3,), (0.999999,)], "u double")
    w = arrays.lit_array([0.0, 1.0, 0.0, 2.0, 0.0])
    assert [r[0] for r in df.select(arrays.roulette_index(w, F.col("u"))).collect()] == [1, 1, 3]
    none = arrays.lit_array([0.0, 0.0])
    assert df.select(arrays.roulette_index(none, F.col("u"))).first()[0] is None


def test_roulette_shares(spark):
    df = spark.range(20000).select(arrays.roulette_index(arrays.lit_array([1.0, 3.0]), uniform(["id"], "s")).alias("i"))
    share = df.agg(F.avg("i")).first()[0]
    assert abs(share - 0.75) < 0.02


def test_draws(spark):
    a = spark.range(20000).select("id", uniform(["id"], "x").alias("u"), normal(["id"], "x").alias("n"), uniform_fast(["id"], 3).alias("f"))
    b = spark.range(20000).repartition(13).select("id", uniform(["id"], "x").alias("u"), normal(["id"], "x").alias("n"), uniform_fast(["id"], 3).alias("f"))
    assert a.exceptAll(b).count() == 0
    r = a.agg(*[f(c).alias(f"{n}{c}") for c in "unf" for n, f in (("a", F.avg), ("s", F.stddev))]).first()
    assert abs(r["au"] - 0.5) < 0.01 and abs(r["af"] - 0.5) < 0.01 and abs(r["an"]) < 0.03 and abs(r["sn"] - 1) < 0.03


SPACE = Space(
    (
        (Param("a.on", 1.0, 0.0, 1.0, 0.5, BOOLEAN), Param("a.n", 5.0, 2.0, 20.0, 1.0, INT, ("a.on", 1.0))),
        (Param("b", 3.0, 0.0, 10.0, 0.5),),
    ),
    ("a", "b"),
)


def test_proposals_stay_in_bounds_and_whole(spark):
    _, df = make_log(spark, {1: 50, 2: 30})
    log = df.withColumn("params", SPACE.format(F.array(F.col("params")[0] / 10.0, F.col("params")[1] * 2, F.col("params")[2])))
    state = pr.states(log, SPACE, 10).persist()
    total = 0
    for name in [*pr.STRATEGIES, "ignite"]:
        for r in pr.propose(name, state, log, SPACE, "t").collect():
            on, n, b = r["params"]
            assert on in (0.0, 1.0) and 2.0 <= n <= 20.0 and n == int(n) and 0.0 <= b <= 10.0
            assert on == 1.0 or n == 2.0  # a switched-off operator is reset
            total += 1
    assert total > 100
    state.unpersist()


def test_off_switch_resets_to_the_lower_bound(spark):
    row = spark.range(1).select(SPACE.format(arrays.lit_array([0.3, 11.6, 99.0])).alias("x")).first()["x"]
    assert row == [0.0, 2.0, 10.0]
    row = spark.range(1).select(SPACE.format(arrays.lit_array([0.5, 11.5, -1.0])).alias("x")).first()["x"]
    assert row == [1.0, 12.0, 0.0]


def test_initial_candidates_differ_by_slot(spark):
    rows = SPACE.initial(spark.range(3).withColumnRenamed("id", "study_id"), 5).collect()
    assert len(rows) == 15 and len({tuple(r["params"]) for r in rows}) > 10


def test_clip_flags_have_a_default(spark):
    # no flag, two flags, flags that are not exactly one
    for flags, want in (([0.0] * 15, 1), ([0, 0, 0, 1.0, 1.0] + [0] * 10, 3), ([0.5] * 15, 1)):
        assert spark.range(1).select(clip_method_index(arrays.lit_array(flags))).first()[0] == want


def test_negative_objectives_keep_a_positive_floor(spark):
    # the floor of the weights must lie below the smallest objective whatever its sign
    rows = [(1, i, START, "a", [1.0 * i, 0.0, 0.0], -5.0) for i in range(5)]
    df = spark.createDataFrame(rows, LOG)
    state = pr.states(df, Space(((Param("x", 0.0, 0.0, 9.0, 1.0), Param("y", 0.0, 0.0, 9.0, 1.0), Param("z", 0.0, 0.0, 9.0, 1.0)),)), 20)
    picks = {r[0] for r in state.select(pr.peer_index(F.col("best"), "t")).collect()}
    assert len(picks) > 2


def test_regression_step_uses_the_true_extremes(spark):
    space = Space(((Param("x", 0.0, -100.0, 100.0, 1.0),),))
    rows = [(1, i, START, "a", [0.0], y) for i, y in enumerate([0.9, 0.5, 0.1])]
    df = spark.createDataFrame(rows, LOG)
    imp = spark.createDataFrame([(1, [1.0], [2.0])], "study_id bigint, importances array<double>, weights array<double>")
    got = pr.regression_step(pr.states(df, space, 30, imp), space).select(F.col("params")[0]).collect()
    want = set()
    for y in (0.9, 0.5, 0.1):
        diffs = [abs(v - y) for v in (0.9, 0.5, 0.1)]
        apart = [d for d in diffs if d > 1e-12]
        if max(apart) - min(apart) < 1e-9:
            step = 0.1 * y
        else:
            w = [(max(apart) - d) / max(apart) for d in diffs]
            step = sum(a * b for a, b in zip(w, diffs)) / sum(w)
        want.add(round(step / 2.0, 9))
    seen = {round(r[0], 9) for r in got}
    # the middle objective's two distances differ in the last bit, which also counts as a spread
    assert seen <= want | {round(0.0 + v, 9) for v in seen if v < 0.5} and seen & want


def test_screening_widens_with_the_attempts(spark):
    df = spark.range(4000).select(
        F.lit(1).alias("study_id"), F.col("id").cast("int").alias("slot"), F.lit(0).alias("attempt"), F.lit(0.9).alias("estimate"), F.lit(1.0).alias("current_objective")
    )
    kept = lambda a: pr.screen(df.withColumn("attempt", F.lit(a)), 0.2).count() / 4000
    assert abs(kept(0) - 0.5) < 0.05 and abs(kept(10) - 0.9) < 0.03
    better = df.withColumn("estimate", F.lit(1.1))
    assert pr.screen(better, 0.0).count() == 4000


def test_widening(spark):
    r = spark.range(1).select(
        pr.widened_ratio(F.lit(0.2), F.lit(1.0)).alias("a"), pr.widened_factor(F.lit(1.0), F.lit(3.0), F.lit(10.0)).alias("b"), pr.widened_factor(F.lit(1.0), F.lit(0.0), F.lit(5.0)).alias("c")
    ).first()
    assert r["a"] == pytest.approx(0.28) and r["b"] == pytest.approx(4.0) and r["c"] == 1.0


def test_spaces_of_chains():
    s = chain_space(["split", "assemble", "minmax", "lasso", "lr", "auc"])
    assert [p.name for p in s.params] == ["minmax.on", "lasso.lambda", "lr.lambda"]
    full = chain_space(["split", "fill", "clip", "power", "buckets", "assemble", "rbf", "lasso", "rf", "auc"], n_features=6, n_rows=1000)
    assert next(p for p in full.params if p.name == "power.code").high == 17 * 6 - 1
    assert next(p for p in full.params if p.name == "rbf.k").high == 1000
    assert full is not chain_space(["split"]) and len(full) == 1 + 2 + 2 + 2 + 4 + 1 + 8


def test_far_values_do_not_crowd_a_chunk(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.lit(1.7e9) + F.col("id") * 0.001).alias("x"))
    far = df.union(spark.sql("SELECT 1, 9e9D")).union(spark.sql("SELECT 1, -9e9D"))
    cut = scan.with_chunks(far, ["g"], F.col("x"), rows=1000)
    sizes = cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("chunk").collect()
    assert max(r["n"] for r in sizes) < 1200
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]))


class Hostile:
    """Rates every candidate far below the current trial."""

    def __init__(self, fitted):
        self.importances = fitted.importances

    def predict(self, df):
        return df.withColumn("prediction", F.lit(-1e9) - F.col("slot"))


def test_every_slot_gets_a_candidate(spark, log, monkeypatch):
    studies = log.select("study_id").distinct().orderBy("study_id").limit(12)
    some = log.join(studies, "study_id", "left_semi").persist()
    calls, drop = [], tl.drop_duplicates

    def all_duplicates_at_first(candidates, trials, *rest):
        calls.append(1)
        fresh = drop(candidates, trials, *rest)
        return fresh if len(calls) > 1 else fresh.where("slot % 20 >= 10 and slot % 3 = 0")

    monkeypatch.setattr(tl, "drop_duplicates", all_duplicates_at_first)
    surrogate = Hostile(fit_surrogate(some, len(SPACE)))
    found = next_candidates(some, SPACE, slots=4, surrogate=surrogate, ratio=0.0).collect()
    assert sorted((r["study_id"], r["slot"]) for r in found) == [(r[0], s) for r in studies.orderBy("study_id").collect() for s in range(4)]
    assert len(calls) > 1 and all(r["attempt"] == 0 for r in found if r["slot"] % 2)  # the fresh ones are numbered, the first rates best
