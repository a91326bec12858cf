"""Queries over proposals: each strategy once over the whole trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunekit.catalog.log import P, SPACE, TOP, cells, fit_sql, gap_sql, predicted
from tunekit.catalog.registry import query
from tunekit.catalog.views import TRIALS, n_sql, q4, r4, trials, u_sql
from tunekit.functions.draws import gaussian, gaussian_nonnegative, gaussian_trimmed, normal, uniform
from tunekit.operators import propose as pr
from tunekit.operators.space import DOUBLE, INT

SLOTS = 3
_K = ["study_id", "slot"]
_SPEC = [("k", 0.0, 99.0, 50.0, 5.0, INT), ("value", 0.0, 500.0, 250.0, 10.0, DOUBLE), ("hour", 0.0, 23.0, 12.0, 1.0, INT)]


# stand-in importances and weights, so that the strategies can be checked without a fit: mean value over its upper bound
def importance_table(spark, sf_dir):
    p = F.col("params")
    means = [F.avg(p[i] / high) for i, (_, _, high, _, _, _) in enumerate(_SPEC)]
    df = trials(spark, sf_dir).groupBy("study_id").agg(*[F.round(m, 6).alias(f"m{i}") for i, m in enumerate(means)])
    whole = F.col("m0") + F.col("m1") + F.col("m2")
    return df.select(
        "study_id",
        F.array(*[F.when(whole > 0, F.col(f"m{i}") / whole).otherwise(1.0 / 3.0) for i in range(3)]).alias("importances"),
        F.array(*[F.col(f"m{i}") - F.lit(0.25) for i in range(3)]).alias("weights"),
    )


def state(spark, sf_dir):
    return pr.states(trials(spark, sf_dir), SPACE, SLOTS, importance_table(spark, sf_dir))


STATE = f"""{TOP}, m AS (SELECT study_id, round(avg(p1 / 99.0::DOUBLE), 6) AS m0, round(avg(p2 / 500.0::DOUBLE), 6) AS m1, round(avg(p3 / 23.0::DOUBLE), 6) AS m2 FROM trials GROUP BY study_id),
  imp AS (SELECT study_id, CASE WHEN s > 0 THEN m0 / s ELSE 1.0 / 3.0 END AS i0, CASE WHEN s > 0 THEN m1 / s ELSE 1.0 / 3.0 END AS i1, CASE WHEN s > 0 THEN m2 / s ELSE 1.0 / 3.0 END AS i2,
    m0 - 0.25::DOUBLE AS w0, m1 - 0.25::DOUBLE AS w1, m2 - 0.25::DOUBLE AS w2 FROM (SELECT *, m0 + m1 + m2 AS s FROM m)),
  cur AS (SELECT study_id, p1 AS c1, p2 AS c2, p3 AS c3 FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY ts DESC, trial_id DESC) AS rn FROM trials) WHERE rn = 1),
  state AS (SELECT cur.*, imp.* EXCLUDE (study_id), slot FROM cur JOIN imp USING (study_id), (SELECT unnest(range({SLOTS}))::INTEGER AS slot))"""


def _roulette_sql(name: str, source: str, keys: str, order: str, u: str) -> str:
    """CTE `name` (keys, pick) from `source` (keys, order, w)."""
    return f"""{name} AS (SELECT {keys}, min({order}) AS pick FROM (
      SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY {keys}) AS whole FROM {source} WHERE w > 0)
      WHERE run >= {u} * whole GROUP BY {keys})"""


def _nonneg_sql(mean: str, ratio: float, n: str) -> str:
    reach = f"abs({mean}) * {ratio * 3.0!r}::DOUBLE"
    return f"greatest(greatest(least({mean} + {n} * {ratio!r}::DOUBLE * abs({mean}), {mean} + {reach}), {mean} - {reach}), 0.0::DOUBLE)"


def _peer_sql(salt: str) -> str:
    """CTE `peer` (study_id, slot, pick = rank in the best set)."""
    mean = "(objective - (low - 1e-6::DOUBLE * abs(low)))"
    n = n_sql(["study_id", "slot", "trial_id"], f"{salt}/peer")
    return f"""pw AS (SELECT study_id, slot, rank, {_nonneg_sql(mean, pr.PEER_JITTER, n)} AS w FROM (
      SELECT top.*, slot, min(objective) OVER (PARTITION BY study_id) AS low FROM top, (SELECT unnest(range({SLOTS}))::INTEGER AS slot))),
    {_roulette_sql('peer', 'pw', 'study_id, slot', 'rank', u_sql(_K, f'{salt}/pick'))}"""


def _format_sql(x: list[str]) -> str:
    return ", ".join(
        f"{q4(fit_sql(f'({v})', low, high, kind))} AS p{i + 1}" for i, (v, (_, low, high, _, _, kind)) in enumerate(zip(x, _SPEC))
    )


def _out(df):
    return df.select(*_K, *cells("params", P))


@query(
    "propose_crossover",
    f"""WITH {STATE}, {_peer_sql('cross')}, c AS (SELECT state.*, top.p1 AS q1, top.p2 AS q2, top.p3 AS q3, greatest(floor({u_sql(['state.study_id', 'state.slot'], 'cross/cut')} * 3), 1) AS cut
      FROM state JOIN peer USING (study_id, slot) JOIN top ON top.study_id = state.study_id AND top.rank = pick)
    SELECT study_id, slot, {_format_sql(['c1', 'CASE WHEN cut > 1 THEN c2 ELSE q2 END', 'q3'])} FROM c""",
)
def propose_crossover(spark, sf_dir):
    return _out(pr.crossover(state(spark, sf_dir), SPACE))


_LONG = """long AS (SELECT study_id, slot, 0 AS i, i0 AS imp FROM state UNION ALL SELECT study_id, slot, 1, i1 FROM state UNION ALL SELECT study_id, slot, 2, i2 FROM state)"""
_RAISED = f"{_LONG}, wl AS (SELECT study_id, slot, i, imp + max(imp) OVER (PARTITION BY study_id, slot) AS w FROM long)"


def _case(values: list[str]) -> str:
    return "CASE pick " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_START = _case([f"{s[3]}::DOUBLE" for s in _SPEC])
_PACE = _case([f"{s[4]}::DOUBLE" for s in _SPEC])


def _sign_sql(salt: str) -> str:
    return f"(CASE WHEN {u_sql(_K, salt + '/sign')} < 0.5 THEN 1.0 ELSE -1.0 END)::DOUBLE"


def _replaced(base: list[str]) -> list[str]:
    return [f"CASE WHEN pick = {i} THEN val ELSE {b} END" for i, b in enumerate(base)]


_CUR = ["c1", "c2", "c3"]


@query(
    "propose_mutation",
    f"""WITH {STATE}, {_LONG}, wl AS (SELECT study_id, slot, i, {_nonneg_sql('imp', pr.PEER_JITTER, n_sql(['study_id', 'slot', 'i'], 'mutate/weight'))} AS w FROM long),
    {_roulette_sql('pk', 'wl', 'study_id, slot', 'i', u_sql(_K, 'mutate/idx'))},
    v AS (SELECT *, {_START} + {_sign_sql('mutate')} * {u_sql(_K, 'mutate/u')} * (abs({_case(_CUR)} - {_START}) + {_PACE} * abs({n_sql(_K, 'mutate/n')})) * 2.0::DOUBLE AS val FROM state JOIN pk USING (study_id, slot))
    SELECT study_id, slot, {_format_sql(_replaced(_CUR))} FROM v""",
)
def propose_mutation(spark, sf_dir):
    return _out(pr.mutation(state(spark, sf_dir), SPACE, factor=2.0))


_RANGE = "rng AS (SELECT study_id, min(p1) AS l0, max(p1) AS h0, min(p2) AS l1, max(p2) AS h1, min(p3) AS l2, max(p3) AS h2 FROM trials GROUP BY study_id)"
_FULL = "CASE i WHEN 0 THEN l0 <= 0 AND h0 >= 99 WHEN 1 THEN l1 <= 0 AND h1 >= 500 ELSE l2 <= 0 AND h2 >= 23 END"


@query(
    "propose_expand",
    f"""WITH {STATE}, {_RANGE}, {_RAISED}, we AS (SELECT wl.study_id, slot, i, CASE WHEN {_FULL} THEN 0 ELSE w END AS w FROM wl JOIN rng USING (study_id)),
    {_roulette_sql('pk', 'we', 'study_id, slot', 'i', u_sql(_K, 'expand/idx'))},
    f AS (SELECT state.*, rng.* EXCLUDE (study_id), pick FROM state JOIN pk USING (study_id, slot) JOIN rng USING (study_id)),
    v AS (SELECT *, CASE WHEN {_sign_sql('expand')} > 0 THEN {_case(['h0', 'h1', 'h2'])} + {_PACE} * (1.0::DOUBLE + abs({n_sql(_K, 'expand/n')})) ELSE {_case(['l0', 'l1', 'l2'])} - {_PACE} * (1.0::DOUBLE + abs({n_sql(_K, 'expand/n')})) END AS val FROM f)
    SELECT study_id, slot, {_format_sql(_replaced(_CUR))} FROM v""",
)
def propose_expand(spark, sf_dir):
    return _out(pr.boundary_expand(state(spark, sf_dir), trials(spark, sf_dir), SPACE))


@query(
    "propose_gap_midpoint",
    f"""WITH {STATE}, {_RAISED}, {_roulette_sql('pk', 'wl', 'study_id, slot', 'i', u_sql(_K, 'gap/idx'))},
    hist AS (SELECT study_id, trial_id, pick, {_case(['p1', 'p2', 'p3'])} AS v FROM trials JOIN (SELECT DISTINCT study_id, pick FROM pk) USING (study_id)),
    {gap_sql('hist', 'study_id, pick', 'v')},
    v AS (SELECT state.*, pick, (lower_v + upper_v) / 2.0::DOUBLE AS val, balanced AND low <= {_case([f'{s[1]}' for s in _SPEC])} AND high >= {_case([f'{s[2]}' for s in _SPEC])} AS done
      FROM state JOIN pk USING (study_id, slot) JOIN gaps USING (study_id, pick))
    SELECT study_id, slot, {_format_sql(_replaced(_CUR))} FROM v WHERE NOT done""",
)
def propose_gap_midpoint(spark, sf_dir):
    return _out(pr.gap_midpoint(state(spark, sf_dir), trials(spark, sf_dir), SPACE))


_PAIR = f"""normed AS (SELECT *, sqrt(p1 * p1 + p2 * p2 + p3 * p3) AS norm FROM trials), {gap_sql('normed', 'study_id', 'norm')},
  pair AS (SELECT g.study_id, (a.p1 + b.p1) / 2.0::DOUBLE AS d1, (a.p2 + b.p2) / 2.0::DOUBLE AS d2, (a.p3 + b.p3) / 2.0::DOUBLE AS d3, abs(a.objective - b.objective) / 2.0::DOUBLE AS step
    FROM gaps g JOIN normed a ON a.study_id = g.study_id AND a.norm = g.lower_v JOIN normed b ON b.study_id = g.study_id AND b.norm = g.upper_v
    QUALIFY row_number() OVER (PARTITION BY g.study_id ORDER BY a.trial_id, b.trial_id) = 1)"""
_MID = ["d1", "d2", "d3"]


@query("propose_ignite", f"WITH {STATE}, {_PAIR} SELECT study_id, slot, {_format_sql(_MID)} FROM state JOIN pair USING (study_id)")
def propose_ignite(spark, sf_dir):
    return _out(pr.ignite(state(spark, sf_dir), trials(spark, sf_dir), SPACE))


@query(
    "propose_ignite_mutation",
    f"""WITH {STATE}, {_PAIR}, {_RAISED}, {_roulette_sql('pk', 'wl', 'study_id, slot', 'i', u_sql(_K, 'ignmut/idx'))},
    v AS (SELECT state.*, pair.* EXCLUDE (study_id), pick, {_case(_MID)} + {_sign_sql('ignmut').replace('study_id', 'state.study_id')} * {_PACE} * (1.0::DOUBLE + abs({n_sql(['state.study_id', 'slot'], 'ignmut/n')})) AS val
      FROM state JOIN pair USING (study_id) JOIN pk USING (study_id, slot))
    SELECT study_id, slot, {_format_sql(_replaced(_MID))} FROM v""",
)
def propose_ignite_mutation(spark, sf_dir):
    return _out(pr.ignite_mutation(state(spark, sf_dir), trials(spark, sf_dir), SPACE))


_W2 = "(w0 * w0 + w1 * w1 + w2 * w2)"


def _climb_sql(base: list[str], step: str) -> list[str]:
    return [f"{b} + w{i} * {step} / {_W2}" for i, b in enumerate(base)]


@query(
    "propose_ignite_regression",
    f"""WITH {STATE}, {_PAIR} SELECT study_id, slot, {_format_sql(_climb_sql(_MID, 'step'))} FROM state JOIN pair USING (study_id)""",
)
def propose_ignite_regression(spark, sf_dir):
    return _out(pr.ignite_regression(state(spark, sf_dir), trials(spark, sf_dir), SPACE))


@query(
    "propose_regression",
    f"""WITH {STATE}, {_peer_sql('regress')}, ch AS (SELECT peer.study_id, slot, p1 AS b1, p2 AS b2, p3 AS b3, objective AS y FROM peer JOIN top ON top.study_id = peer.study_id AND top.rank = pick),
    df AS (SELECT ch.*, abs(top.objective - y) AS d FROM ch JOIN top USING (study_id)),
    ex AS (SELECT study_id, slot, max(CASE WHEN d > 0 THEN d END) AS hi, min(CASE WHEN d > 0 THEN d END) AS lo FROM df GROUP BY study_id, slot),
    st AS (SELECT df.study_id, df.slot, b1, b2, b3, CASE WHEN max(hi) IS NOT NULL AND max(hi) <> max(lo) THEN sum((hi - d) / hi * d) / sum((hi - d) / hi) ELSE y * 0.1::DOUBLE END AS step
      FROM df JOIN ex ON ex.study_id = df.study_id AND ex.slot = df.slot GROUP BY df.study_id, df.slot, b1, b2, b3, y)
    SELECT study_id, slot, {_format_sql(_climb_sql(['b1', 'b2', 'b3'], 'step'))} FROM state JOIN st USING (study_id, slot)""",
)
def propose_regression(spark, sf_dir):
    return _out(pr.regression_step(state(spark, sf_dir), SPACE))


@query(
    "sample_roulette",
    f"""WITH {TRIALS}, src AS (SELECT study_id, trial_id, objective AS w FROM trials), {_roulette_sql('pk', 'src', 'study_id', 'trial_id', u_sql(['study_id'], 'roulette'))}
    SELECT study_id, pick AS trial_id FROM pk""",
)
def sample_roulette(spark, sf_dir):
    return pr.roulette_pick(trials(spark, sf_dir), ["study_id"], "objective", "trial_id", uniform(["study_id"], "roulette"))


_N = n_sql(["trial_id"], "gauss")


@query(
    "sample_gaussian",
    f"""WITH {TRIALS} SELECT trial_id, {q4(f'p1 + {_N} * 0.1::DOUBLE * abs(p1)')} AS plain,
      {q4(f'greatest(least(p1 + {_N} * 0.1::DOUBLE * abs(p1), p1 + abs(p1) * 0.1::DOUBLE), p1 - abs(p1) * 0.1::DOUBLE)')} AS trimmed,
      {q4(_nonneg_sql('(p1 - 50.0::DOUBLE)', 0.5, _N))} AS nonneg FROM trials""",
)
def sample_gaussian(spark, sf_dir):
    n, p = normal(["trial_id"], "gauss"), F.col("params")[0]
    return trials(spark, sf_dir).select(
        "trial_id",
        r4(gaussian(p, 0.1, n)).alias("plain"),
        r4(gaussian_trimmed(p, 0.1, n, 1.0)).alias("trimmed"),
        r4(gaussian_nonnegative(p - 50.0, 0.5, n)).alias("nonneg"),
    )


_REWARD = f"""{TRIALS}, seq AS (SELECT *, row_number() OVER (PARTITION BY study_id, strategy ORDER BY ts DESC, trial_id DESC) - 1 AS age FROM trials),
  reward AS (SELECT study_id, strategy, count(*)::BIGINT AS n, sum(0.2::DOUBLE * pow(0.8::DOUBLE, age) * objective) + pow(0.8::DOUBLE, count(*)) AS reward FROM seq GROUP BY study_id, strategy)"""


@query("strategy_reward", f"WITH {_REWARD} SELECT study_id, strategy, n, {q4('reward')} AS reward FROM reward")
def strategy_reward(spark, sf_dir):
    return pr.rewards(trials(spark, sf_dir)).select("study_id", "strategy", "n", r4(F.col("reward")).alias("reward"))


_NAMES = ["click", "error", "purchase", "signup", "view"]


@query(
    "strategy_pick",
    f"""WITH {_REWARD}, names AS (SELECT unnest(range(5)) AS i, unnest({_NAMES}) AS strategy),
    full_t AS (SELECT s.study_id, i, names.strategy, coalesce(reward, 1.0) AS r FROM (SELECT DISTINCT study_id FROM trials) s CROSS JOIN names LEFT JOIN reward ON reward.study_id = s.study_id AND reward.strategy = names.strategy),
    j AS (SELECT *, r - (low - 1e-6::DOUBLE * abs(low)) AS m FROM (SELECT full_t.*, slot, min(r) OVER (PARTITION BY study_id) AS low FROM full_t, (SELECT unnest(range({SLOTS}))::INTEGER AS slot))),
    wl AS (SELECT study_id, slot, i, CASE WHEN strategy = 'signup' THEN 0 ELSE greatest(m + {n_sql(['study_id', 'slot', 'i'], 'strategy/n')} * 0.1::DOUBLE * abs(m), 0.0::DOUBLE) END AS w FROM j),
    {_roulette_sql('pk', 'wl', 'study_id, slot', 'i', u_sql(_K, 'strategy/u'))}
    SELECT study_id, slot, {_NAMES}[pick + 1] AS strategy FROM pk""",
)
def strategy_pick(spark, sf_dir):
    df = trials(spark, sf_dir)
    table = pr.strategy_table(df.select("study_id").distinct(), pr.rewards(df), _NAMES)
    return pr.pick_strategy(table, SLOTS, _NAMES, dead=["signup"])


# every trial is an attempt: slot = trial_id mod 7, attempt by its order in the slot, estimate p1 / 100
@query(
    "screen_accept",
    f"""WITH {TRIALS}, a AS (SELECT study_id, (trial_id % 7)::INTEGER AS slot, (hash_free % 10)::INTEGER AS attempt, trial_id, p1 / 100.0::DOUBLE AS est, objective AS cur FROM (SELECT *, trial_id // 7 AS hash_free FROM trials)),
    ok AS (SELECT * FROM a WHERE est >= cur OR 1.0::DOUBLE - est / cur <= (0.2::DOUBLE + 0.8::DOUBLE * attempt / 10.0::DOUBLE) * {u_sql(['study_id', 'slot', 'attempt'], 'screen')})
    SELECT study_id, slot, attempt, trial_id FROM ok QUALIFY row_number() OVER (PARTITION BY study_id, slot ORDER BY attempt, est, trial_id) = 1""",
)
def screen_accept(spark, sf_dir):
    t = F.col("trial_id")
    df = predicted(spark, sf_dir).select(
        "study_id",
        (t % 7).cast("int").alias("slot"),
        (F.floor(t / 7) % 10).cast("int").alias("attempt"),
        F.col("prediction").alias("estimate"),
        t.alias("trial_id"),
        F.col("objective").alias("current_objective"),
        "params",
    )
    return pr.screen(df, 0.2).select("study_id", "slot", "attempt", "trial_id")


@query(
    "screen_widen",
    f"""WITH {TRIALS}, s AS (SELECT study_id, strategy, (count(*) % 5)::DOUBLE AS dups, (count(*) % 23)::DOUBLE AS uses, avg(objective) AS r FROM trials GROUP BY study_id, strategy)
    SELECT study_id, strategy, {q4('least(1.0 - (1.0 - r) * pow(0.9::DOUBLE, dups), 1.0)')} AS ratio, {q4(f'greatest(pow(2.0::DOUBLE, dups) * pow({pr.ANNEAL!r}::DOUBLE, uses), 1.0)')} AS factor FROM s""",
)
def screen_widen(spark, sf_dir):
    n = F.count(F.lit(1))
    s = trials(spark, sf_dir).groupBy("study_id", "strategy").agg((n % 5).alias("dups"), (n % 23).alias("uses"), F.avg("objective").alias("r"))
    return s.select(
        "study_id",
        "strategy",
        r4(pr.widened_ratio(F.col("r"), F.col("dups"))).alias("ratio"),
        r4(pr.widened_factor(F.lit(1.0), F.col("dups"), F.col("uses"))).alias("factor"),
    )
