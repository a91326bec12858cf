"""Queries over the trial log: search-space rules, ranking, gaps, duplicates, convergence."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tunekit.catalog.registry import query
from tunekit.catalog.views import TRIALS, n_sql, q4, r4, trials
from tunekit.functions.draws import normal
from tunekit.operators import trials as tl
from tunekit.operators.columns import trial_vectors
from tunekit.operators.prep import CLIP_METHODS, clip_method_index
from tunekit.operators.space import BOOLEAN, DOUBLE, INT, Param, Space

# the space of the log's three parameters: two operators
SPACE = Space(
    (
        (Param("k", 50.0, 0.0, 99.0, 5.0, INT), Param("value", 250.0, 0.0, 500.0, 10.0, DOUBLE)),
        (Param("hour", 12.0, 0.0, 23.0, 1.0, INT),),
    ),
    ("first", "second"),
)

# a switch, two parameters behind it, a code and a parameter that needs code 5
GATED = Space(
    (
        (
            Param("on", 1.0, 0.0, 1.0, 0.5, BOOLEAN),
            Param("count", 2.0, 2.0, 50.0, 1.0, INT, ("on", 1.0)),
            Param("ratio", 0.2, 0.01, 10.0, 0.01, DOUBLE, ("on", 1.0)),
        ),
        (Param("code", 0.0, 0.0, 5.0, 1.0, INT), Param("share", 0.0, 0.05, 1.0, 0.05, DOUBLE, ("code", 5.0))),
    ),
    ("gated", "coded"),
)


def cells(array, names, round4=True):
    """Array elements as columns."""
    col = F.col(array) if isinstance(array, str) else array
    return [(r4(col[i]) if round4 else col[i]).alias(n) for i, n in enumerate(names)]


P = ["p1", "p2", "p3"]


@query("trial_features", f"WITH {TRIALS} SELECT study_id, trial_id, p1, p2, p3, objective AS label FROM trials")
def trial_features(spark, sf_dir):
    df = trial_vectors(trials(spark, sf_dir)).withColumn("x", vector_to_array("features"))
    return df.select("study_id", "trial_id", *cells("x", P, False), "label")


def fit_sql(x: str, low: float, high: float, kind: int) -> str:
    """Clamp and round, as SQL."""
    inside = x if kind == DOUBLE else f"floor({x} + 0.5::DOUBLE)"
    return f"(CASE WHEN {x} >= {high} THEN {high} WHEN {x} <= {low} THEN {low} ELSE {inside} END)::DOUBLE"


# candidates: the log's vectors shifted by draws, so that they leave the bounds
def _moved(spark, sf_dir):
    n = [normal(["trial_id"], f"move{i}") for i in range(3)]
    p = F.col("params")
    return trials(spark, sf_dir).withColumn(
        "raw", F.array(p[0] + n[0] * F.lit(40.0), p[1] + n[1] * F.lit(200.0), p[2] + n[2] * F.lit(8.0))
    )


_MOVED = f"""{TRIALS}, moved AS (SELECT study_id, trial_id, p1 + {n_sql(['trial_id'], 'move0')} * 40.0::DOUBLE AS r1,
  p2 + {n_sql(['trial_id'], 'move1')} * 200.0::DOUBLE AS r2, p3 + {n_sql(['trial_id'], 'move2')} * 8.0::DOUBLE AS r3 FROM trials)"""


@query(
    "space_format",
    f"""WITH {_MOVED} SELECT study_id, trial_id, {fit_sql('r1', 0.0, 99.0, INT)} AS p1, {q4(fit_sql('r2', 0.0, 500.0, DOUBLE))} AS p2,
      {fit_sql('r3', 0.0, 23.0, INT)} AS p3 FROM moved""",
)
def space_format(spark, sf_dir):
    df = _moved(spark, sf_dir).withColumn("x", SPACE.format(F.col("raw")))
    return df.select("study_id", "trial_id", *cells("x", P))


@query(
    "space_off_switch",
    f"""WITH {_MOVED}, f AS (SELECT study_id, trial_id, {fit_sql('r1 / 99.0::DOUBLE', 0.0, 1.0, BOOLEAN)} AS a, {fit_sql('r1', 2.0, 50.0, INT)} AS b,
      {fit_sql('r2 / 100.0::DOUBLE', 0.01, 10.0, DOUBLE)} AS c, {fit_sql('r3 / 4.0::DOUBLE', 0.0, 5.0, INT)} AS d, {fit_sql('r2 / 500.0::DOUBLE', 0.05, 1.0, DOUBLE)} AS e FROM moved)
    SELECT study_id, trial_id, a AS gate, CASE WHEN a < 1 THEN 2.0 ELSE b END::DOUBLE AS cnt, {q4('CASE WHEN a < 1 THEN 0.01 ELSE c END')} AS ratio,
      d AS code, {q4('CASE WHEN d < 5 THEN 0.05 ELSE e END')} AS share FROM f""",
)
def space_off_switch(spark, sf_dir):
    r = F.col("raw")
    raw = F.array(r[0] / 99.0, r[0], r[1] / 100.0, r[2] / 4.0, r[1] / 500.0)
    df = _moved(spark, sf_dir).withColumn("x", GATED.format(raw))
    return df.select("study_id", "trial_id", *cells("x", ["gate", "cnt", "ratio", "code", "share"]))


@query(
    "space_index",
    """SELECT user_id AS study_id, event_id AS trial_id, (event_id % 5)::INTEGER AS param_idx, CASE WHEN event_id % 5 < 3 THEN 0 ELSE 1 END::INTEGER AS op_idx,
      CASE WHEN event_id % 5 < 3 THEN 0 ELSE 3 END::INTEGER AS first_idx, CASE WHEN event_id % 5 < 3 THEN 2 ELSE 4 END::INTEGER AS last_idx FROM events""",
)
def space_index(spark, sf_dir):
    df = trials(spark, sf_dir).select("study_id", "trial_id", (F.col("trial_id") % 5).cast("int").alias("param_idx"))
    df = df.withColumn("op_idx", GATED.op_of(F.col("param_idx")))
    return df.withColumn("first_idx", GATED.first_of(F.col("op_idx"))).withColumn("last_idx", GATED.last_of(F.col("op_idx")))


_METHOD_SQL = "CASE m " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(CLIP_METHODS)) + " END"
_K_SQL = "CASE m " + " ".join(f"WHEN {i} THEN {k}::DOUBLE" for i, (_, k) in enumerate(CLIP_METHODS)) + " END"


@query(
    "space_outlier_methods",
    f"""WITH f AS (SELECT event_id AS trial_id, list_transform(range(15), lambda i: CASE WHEN ((event_id * 7 + i * 5) % 16) = 0 OR ((event_id + i * 11) % 31) = 0 THEN 1 ELSE 0 END) AS flags FROM events),
    g AS (SELECT trial_id, CASE WHEN list_contains(flags, 1) THEN list_position(flags, 1) - 1 ELSE 1 END AS m FROM f)
    SELECT trial_id, m::INTEGER AS method_idx, {_METHOD_SQL} AS method, {_K_SQL} AS k FROM g""",
)
def space_outlier_methods(spark, sf_dir):
    t = F.col("trial_id")
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(14)),
        lambda i: F.when(((t * 7 + i * 5) % 16 == 0) | ((t + i * 11) % 31 == 0), 1.0).otherwise(0.0),
    )
    df = trials(spark, sf_dir).select("trial_id", clip_method_index(flags).alias("method_idx"))
    known = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("k")) for m, k in CLIP_METHODS])
    found = F.element_at(known, F.col("method_idx") + 1)
    return df.select("trial_id", "method_idx", found["method"].alias("method"), found["k"].alias("k"))


_STUDIES = f"{TRIALS}, studies AS (SELECT DISTINCT study_id FROM trials)"


@query(
    "propose_initial",
    f"""WITH {_STUDIES}, s AS (SELECT study_id, unnest(range(4))::INTEGER AS slot FROM studies),
    r AS (SELECT study_id, slot, 50.0::DOUBLE + 5.0::DOUBLE * {n_sql(['study_id', 'slot'], 'init/0')} AS r1,
      250.0::DOUBLE + 10.0::DOUBLE * {n_sql(['study_id', 'slot'], 'init/1')} AS r2, 12.0::DOUBLE + 1.0::DOUBLE * {n_sql(['study_id', 'slot'], 'init/2')} AS r3 FROM s)
    SELECT study_id, slot, {fit_sql('r1', 0.0, 99.0, INT)} AS p1, {q4(fit_sql('r2', 0.0, 500.0, DOUBLE))} AS p2, {fit_sql('r3', 0.0, 23.0, INT)} AS p3 FROM r""",
)
def propose_initial(spark, sf_dir):
    studies = trials(spark, sf_dir).select("study_id").distinct()
    return SPACE.initial(studies, 4).select("study_id", "slot", *cells("params", P))


_NORMED = f"{TRIALS}, normed AS (SELECT *, sqrt(p1 * p1 + p2 * p2 + p3 * p3) AS norm FROM trials)"


@query(
    "trial_norms",
    f"""WITH {_NORMED} SELECT study_id, trial_id, {q4('norm')} AS norm, {q4('min(norm) OVER w')} AS min_norm, {q4('max(norm) OVER w')} AS max_norm
    FROM normed WINDOW w AS (PARTITION BY study_id)""",
)
def trial_norms(spark, sf_dir):
    df = trials(spark, sf_dir)
    both = tl.with_norm(df).join(tl.norm_span(df), "study_id")
    return both.select("study_id", "trial_id", *[r4(F.col(c)).alias(c) for c in ("norm", "min_norm", "max_norm")])


TOP = f"{TRIALS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY objective DESC, trial_id) AS rank FROM trials) WHERE rank <= 10)"


@query("trial_topk", f"WITH {TOP} SELECT study_id, rank::INTEGER AS rank, trial_id, p1, p2, p3, objective FROM top")
def trial_topk(spark, sf_dir):
    df = tl.top_trials(trials(spark, sf_dir))
    return df.select("study_id", "rank", "trial_id", *cells("params", P, False), "objective")


@query(
    "trial_range",
    f"""WITH {TRIALS} """
    + " UNION ALL ".join(
        f"SELECT study_id, {i}::INTEGER AS param_idx, min({p}) AS low, max({p}) AS high FROM trials GROUP BY study_id" for i, p in enumerate(P)
    ),
)
def trial_range(spark, sf_dir):
    df = tl.param_ranges(trials(spark, sf_dir), 3)
    both = df.select("study_id", F.posexplode(F.arrays_zip("low", "high")).alias("param_idx", "r"))
    return both.select("study_id", "param_idx", "r.low", "r.high")


# candidates: a third repeats a trial of the same study, a third nearly, a third lies elsewhere; every fifth names the repeated trial as parent
def dedup_candidates(spark, sf_dir):
    t = F.col("trial_id")
    p = F.col("params")
    shift = F.when(t % 3 == 0, 0.0).when(t % 3 == 1, 1e-9).otherwise(0.37)
    parent = F.when(t % 5 == 0, p)
    return trials(spark, sf_dir).select("study_id", t.alias("slot"), F.array(p[0], p[1] + shift, p[2]).alias("params"), parent.alias("parent"))


@query(
    "trial_dedup",
    f"""WITH {_NORMED}, span AS (SELECT study_id, max(norm) - min(norm) AS span FROM normed GROUP BY study_id),
    c AS (SELECT study_id, trial_id AS slot, p1 AS c1, p2 + CASE trial_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1e-9::DOUBLE ELSE 0.37::DOUBLE END AS c2, p3 AS c3,
      trial_id % 5 = 0 AS has_parent, p1 AS a1, p2 AS a2, p3 AS a3 FROM trials)
    SELECT study_id, slot FROM c JOIN span USING (study_id) WHERE NOT EXISTS (
      SELECT 1 FROM normed t WHERE t.study_id = c.study_id AND abs(sqrt(c1 * c1 + c2 * c2 + c3 * c3) - t.norm) / span < 1e-6
        AND sqrt((c1 - p1) * (c1 - p1) + (c2 - p2) * (c2 - p2) + (c3 - p3) * (c3 - p3)) / span < 1e-6
        AND (NOT has_parent OR sqrt((a1 - p1) * (a1 - p1) + (a2 - p2) * (a2 - p2) + (a3 - p3) * (a3 - p3)) / span >= 1e-6))""",
)
def trial_dedup(spark, sf_dir):
    return tl.drop_duplicates(dedup_candidates(spark, sf_dir), trials(spark, sf_dir)).select("study_id", "slot")


def gap_sql(source: str, keys: str, value: str) -> str:
    """CTEs ending in `gaps` (keys, n, low, high, balanced, lower_v, lower_id, upper_v, upper_id)."""
    return f"""g0 AS (SELECT {keys}, {value} AS v, trial_id AS id FROM {source}),
    g1 AS (SELECT {keys}, count(*) AS n, min(v) AS low, max(v) AS high FROM g0 GROUP BY {keys}),
    g2 AS (SELECT g0.*, n, low, high, CASE WHEN high > low THEN least(floor((v - low) * n / (high - low)), n - 1) ELSE 0 END::BIGINT AS b FROM g0 JOIN g1 USING ({keys})),
    g3 AS (SELECT {keys}, n, low, high, b, min(v) AS lo, max(v) AS hi FROM g2 GROUP BY {keys}, n, low, high, b),
    g4 AS (SELECT *, lag(b) OVER w AS pb, lag(hi) OVER w AS ph FROM g3 WINDOW w AS (PARTITION BY {keys} ORDER BY b)),
    g5 AS (SELECT {keys}, n, low, high, count(*) = n OR count(*) = 1 AS balanced FROM g3 GROUP BY {keys}, n, low, high),
    g6 AS (SELECT g4.{keys.replace(', ', ', g4.')}, ph, lo, row_number() OVER (PARTITION BY g4.{keys.replace(', ', ', g4.')} ORDER BY CASE WHEN balanced THEN lo - ph ELSE b - pb END DESC, CASE WHEN balanced THEN b ELSE -b END) AS rn
      FROM g4 JOIN g5 USING ({keys}) WHERE pb IS NOT NULL),
    gaps AS (SELECT {keys}, g5.n, g5.low, g5.high, balanced, coalesce(ph, g5.low) AS lower_v, coalesce(g6.lo, g5.low) AS upper_v
      FROM g5 LEFT JOIN (SELECT * FROM g6 WHERE rn = 1) g6 USING ({keys}))"""


@query(
    "trial_max_gap",
    f"""WITH {_NORMED}, long AS (SELECT study_id, trial_id, 0 AS col, p1 AS v FROM trials UNION ALL SELECT study_id, trial_id, 1, p2 FROM trials UNION ALL
      SELECT study_id, trial_id, 2, p3 FROM trials UNION ALL SELECT study_id, trial_id, 3, norm FROM normed), {gap_sql('long', 'study_id, col', 'v')}
    SELECT study_id, col::INTEGER AS col, n::BIGINT AS n, balanced, {q4('lower_v')} AS lower_value, {q4('upper_v')} AS upper_value FROM gaps""",
)
def trial_max_gap(spark, sf_dir):
    df = tl.with_norm(trials(spark, sf_dir))
    long = df.select("study_id", "trial_id", F.posexplode(F.concat("params", F.array("norm"))).alias("col", "v"))
    gaps = tl.largest_gap(long, ["study_id", "col"], "v", "trial_id")
    return gaps.select("study_id", "col", "n", "balanced", r4(F.col("lower.v")).alias("lower_value"), r4(F.col("upper.v")).alias("upper_value"))


_RUNS = f"""{TRIALS}, r1 AS (SELECT *, row_number() OVER w AS run, max(objective) OVER w AS best FROM trials WINDOW w AS (PARTITION BY study_id ORDER BY ts, trial_id)),
  r2 AS (SELECT *, best - coalesce(lag(best) OVER (PARTITION BY study_id ORDER BY run), 0) > 1e-4::DOUBLE AS moved FROM r1),
  r3 AS (SELECT *, run - coalesce(max(CASE WHEN moved THEN run END) OVER (PARTITION BY study_id ORDER BY run), 0) AS steady FROM r2)"""


@query(
    "trial_convergence",
    f"WITH {_RUNS} SELECT study_id, trial_id, run::BIGINT AS run, best, steady::BIGINT AS steady, run > 40 AND (run > 80 OR steady > 20) AS stop FROM r3",
)
def trial_convergence(spark, sf_dir):
    return tl.convergence(trials(spark, sf_dir), min_trials=40, max_trials=80)


@query(
    "trial_convergence_summary",
    f"""WITH {_RUNS} SELECT study_id, max(run)::BIGINT AS n_trials, max(best) AS best, arg_max(steady, run)::BIGINT AS steady,
    min(CASE WHEN run > 40 AND (run > 80 OR steady > 20) THEN run END)::BIGINT AS stop_run FROM r3 GROUP BY study_id""",
)
def trial_convergence_summary(spark, sf_dir):
    return tl.convergence_summary(tl.convergence(trials(spark, sf_dir), min_trials=40, max_trials=80))


# a stand-in prediction, so that the arithmetic can be checked: p1 / 100
def predicted(spark, sf_dir):
    return trials(spark, sf_dir).withColumn("prediction", F.col("params")[0] / 100.0)


_RATIO = "sum(abs(p1 / 100.0::DOUBLE - objective)) / sum(objective)"


@query("trial_accept_ratio", f"WITH {TOP} SELECT study_id, {q4(_RATIO)} AS accept_ratio FROM top GROUP BY study_id")
def trial_accept_ratio(spark, sf_dir):
    return tl.accept_ratio(predicted(spark, sf_dir)).select("study_id", r4(F.col("accept_ratio")).alias("accept_ratio"))


@query(
    "sink_convergence_lines",
    f"""WITH {_RUNS}, top AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY objective DESC, trial_id) AS rank FROM trials QUALIFY rank <= 10),
    b AS (SELECT study_id, {_RATIO} AS ratio, string_agg(printf('%.6f,%.6f,%.6f,%.6f', p1, p2, p3, objective), chr(9) ORDER BY rank) AS best FROM top GROUP BY study_id),
    s AS (SELECT study_id, max(run) AS n, arg_max(steady, run) AS steady FROM r3 GROUP BY study_id)
    SELECT study_id, concat_ws(chr(9), n::VARCHAR, steady::VARCHAR, printf('%.6f', ratio), best) AS line FROM s JOIN b USING (study_id)""",
)
def sink_convergence_lines(spark, sf_dir):
    df = predicted(spark, sf_dir)
    summary = tl.convergence_summary(tl.convergence(df)).join(tl.accept_ratio(df), "study_id")
    return tl.convergence_lines(summary, tl.best_sets(df))
