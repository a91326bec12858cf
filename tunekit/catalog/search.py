"""Queries over what a search is built from: boosted surrogates, shared preparation, objectives of several metrics, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunekit.catalog.registry import query
from tunekit.catalog.views import FEATURES, KEYS, SCORES, TRAIN_MISSING, TRIALS, q4, r4, scores, train_missing, trials, u_sql
from tunekit.operators import boost, split, train, validate
from tunekit.plans.chain import Chain
from tunekit.plans.generation import walk

_KEYS = ["trial_id", "fold", "split"]

# ---------------------------------------------------------------- boosted surrogates


# an objective that depends on two parameters in every study, so that the chosen one differs between studies; its sums are exact in binary
@query(
    "surrogate_boost_stump",
    f"""WITH {TRIALS}, o AS (SELECT study_id, p1, p2, p3, p1 / 128.0::DOUBLE + p3 / 32.0::DOUBLE AS y FROM trials),
    long AS (SELECT study_id, 0 AS f, p1 AS v, y FROM o UNION ALL SELECT study_id, 1, p2, y FROM o UNION ALL SELECT study_id, 2, p3, y FROM o),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY study_id, f ORDER BY v) AS rn, count(*) OVER (PARTITION BY study_id, f) AS n FROM long),
    cut AS (SELECT DISTINCT study_id, f, v AS c FROM ranked, (SELECT unnest(range(1, 32)) AS j) WHERE rn = ceil(j / 32.0::DOUBLE * n)),
    side AS (SELECT study_id, f, c, sum(y) FILTER (v <= c) AS ls, count(*) FILTER (v <= c)::DOUBLE AS ln, sum(y) AS ts, count(*)::DOUBLE AS tn
      FROM long JOIN cut USING (study_id, f) GROUP BY study_id, f, c),
    gain AS (SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS g FROM side WHERE tn > ln),
    best AS (SELECT * FROM gain WHERE g > (ts * ts / tn + 1) * 1e-12 QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY round(g, 9) DESC, f, c) = 1)
    SELECT study_id, f::INTEGER AS feature, c AS threshold, ls / ln AS left, (ts - ls) / (tn - ln) AS right FROM best""",
)
def surrogate_boost_stump(spark, sf_dir):
    """One round of depth 1: the first split of every study and the mean objectives on both sides."""
    p = F.col("params")
    df = trials(spark, sf_dir).withColumn("objective", p[0] / 128.0 + p[2] / 32.0)
    found = boost.stump_table(df, 3).where(F.col("feature") >= 0)
    return found.select("study_id", "feature", "threshold", "left", "right")


@query("surrogate_boosted")
def surrogate_boosted(spark, sf_dir):
    """The boosted surrogate alone: importances and mean error of every study."""
    df = trials(spark, sf_dir)
    both = df.join(boost.boosted_surrogates(df, 3), "study_id")
    error = F.abs(boost.boosted_prediction(F.col("trees"), F.col("params")) - F.col("objective"))
    shares = [F.first(F.col("tree_importances")[i]).alias(f"i{i + 1}") for i in range(3)]
    return both.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(error)).alias("error"), *shares)


# ---------------------------------------------------------------- shared preparation

_PREFIX = Chain(("split", "fill", "assemble", "minmax", "standardize", "lr", "auc"), n_features=4)
_CANDIDATES = {0: (1.0, 1.0), 1: (1.0, 0.0), 2: (0.0, 1.0), 3: (1.0, 1.0)}  # switches of min-max and of standardisation


def _prefix_sql() -> str:
    rows = []
    for t, (minmax, standard) in _CANDIDATES.items():
        for c in FEATURES:
            rows.append(f"SELECT {t}::BIGINT AS trial_id, 'fill' AS op, '{c}' AS feature, 'mean' AS key, m_{c} AS value FROM s")
            if minmax:
                rows += [f"SELECT {t}, 'minmax', '{c}', '{k}', {e}_{c} FROM s" for k, e in (("min", "a"), ("max", "b"))]
            if standard:
                scaled = f"(b_{c} - a_{c})" if minmax else "1.0::DOUBLE"
                shift = f"a_{c}" if minmax else "0.0::DOUBLE"
                rows.append(f"SELECT {t}, 'standardize', '{c}', 'mean', (m_{c} - {shift}) / {scaled} FROM s")
                rows.append(f"SELECT {t}, 'standardize', '{c}', 'stddev', d_{c} / {scaled} FROM s")
    means = ", ".join(f"avg({c}) AS g_{c}" for c in FEATURES)
    filled = ", ".join(f"coalesce({c}, g_{c}) AS {c}" for c in FEATURES)
    stats = ", ".join(f"avg({c}) AS m_{c}, min({c}) AS a_{c}, max({c}) AS b_{c}, stddev_samp({c}) AS d_{c}" for c in FEATURES)
    return f"""WITH {TRAIN_MISSING}, a AS (SELECT * FROM train_missing WHERE {u_sql(KEYS, 'a7')} < 0.5::DOUBLE),
    g AS (SELECT {means} FROM a), filled AS (SELECT {filled} FROM a, g), s AS (SELECT {stats} FROM filled)
    SELECT trial_id, op, feature, key, (round(value, 6) + 0.0::DOUBLE) AS value FROM ({' UNION ALL '.join(rows)})"""


@query("generation_prefix_tree", _prefix_sql())
def generation_prefix_tree(spark, sf_dir):
    """Fitted constants of four candidates that share their first transforms: each transform is fitted once per prefix."""
    marked = _PREFIX.marked(train_missing(spark, sf_dir), FEATURES, KEYS)
    vectors = {t: [0.0, *switches, 0.2] for t, switches in _CANDIDATES.items()}
    rows = []

    def failed(members, error):
        raise error

    for prepared, members in walk(_PREFIX, marked, vectors, failed):
        rows += [(t, op, c, k, float(v)) for t in members for op, f in prepared.fitted for c, k, v in f.constants]
        prepared.release()
    df = spark.createDataFrame(rows, "trial_id long, op string, feature string, key string, value double")
    return df.withColumn("value", F.round("value", 6) + F.lit(0.0))


# ---------------------------------------------------------------- objectives of several metrics

_COUNTS = """counts AS (
  SELECT trial_id, fold, split, score, sum(w * CASE WHEN label > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pos,
    sum(w * CASE WHEN label > 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS neg FROM weighed GROUP BY trial_id, fold, split, score),
run AS (SELECT *, coalesce(sum(neg) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (o) AS cp, sum(neg) OVER (o) AS cn,
  sum(pos) OVER (PARTITION BY trial_id, fold, split) AS p, sum(neg) OVER (PARTITION BY trial_id, fold, split) AS q FROM counts
  WINDOW o AS (PARTITION BY trial_id, fold, split ORDER BY score)),
wide AS (SELECT trial_id, fold, split, sum(pos * (below + neg / 2)) / (any_value(p) * any_value(q)) AS auc, max(abs(cp / p - cn / q)) AS ks,
  2 * sum(CASE WHEN score >= 0.5::DOUBLE THEN pos ELSE 0 END) / (any_value(p) + sum(CASE WHEN score >= 0.5::DOUBLE THEN pos + neg ELSE 0 END)) AS f1
  FROM run GROUP BY trial_id, fold, split)"""
_METRICS = ["auc", "ks", "f1@0.5"]
#: AUC, KS and F1 with weights of their own, for the folds and for the final model.
_GOAL = validate.Objective(
    fold={"auc": (-1.0, 1.0, 0.0, 0.0, 0.5), "ks": (0.0, 0.0, 0.25, 0.0, 1.0)},
    final={"ks": (0.0, 0.5, 0.0, -0.25, 1.0), "f1@0.5": (0.0, 0.0, 0.0, 0.0, 0.125)},
    pair=(0.0, 0.0, 1.0, 0.25, 0.75),
)


@query(
    "validate_metrics_objective",
    f"""WITH {SCORES}, weighed AS (SELECT *, 1.0::DOUBLE AS w FROM scores), {_COUNTS},
    pair AS (SELECT trial_id, fold, max(auc) FILTER (split = 'A') AS ax, max(auc) FILTER (split = 'B') AS ay, max(ks) FILTER (split = 'A') AS kx,
      max(ks) FILTER (split = 'B') AS ky, max(f1) FILTER (split = 'B') AS fy FROM wide GROUP BY trial_id, fold),
    v AS (SELECT trial_id, avg(-ax * ax + ay * ay + 0.5 * ay + 0.25 * kx * ky + ky) FILTER (fold > 0) AS cv,
      max(0.5 * ky * ky - 0.25 * kx + ky + 0.125 * fy) FILTER (fold = 0) AS final, max(kx) FILTER (fold = 0) AS x, max(ky) FILTER (fold = 0) AS y FROM pair GROUP BY trial_id)
    SELECT trial_id, {q4('cv')} AS cv, {q4('final')} AS final, {q4('cv * final + 0.25 * cv + 0.75 * final')} AS objective, {q4('x')} AS train_value, {q4('y')} AS test_value FROM v""",
)
def validate_metrics_objective(spark, sf_dir):
    """One objective from AUC, KS and F1, all of one pass over the counted scores; fold 0 stands for the final fit."""
    found = validate.measures(scores(spark, sf_dir), _KEYS, _METRICS)
    pairs = validate.train_test_pairs(found, ["trial_id", "fold", "metric"], "value")
    pairs = pairs.withColumn("fold", F.when(F.col("fold") == 0, train.FINAL).otherwise(F.col("fold")))
    values = train.trial_values(pairs, _GOAL)
    return values.select("trial_id", *[r4(F.col(c)).alias(c) for c in ("cv", "final", "objective", "train_value", "test_value")])


@query(
    "validate_weighted",
    f"""WITH {SCORES}, c AS (SELECT label, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS whole FROM scores GROUP BY label),
    weighed AS (SELECT s.*, whole / (2 * n) * (1 + fold) AS w FROM scores s JOIN c USING (label)), {_COUNTS}
    SELECT trial_id, fold, split, metric, {q4('value')} AS value FROM (
      SELECT trial_id, fold, split, 'auc' AS metric, auc AS value FROM wide UNION ALL SELECT trial_id, fold, split, 'ks', ks FROM wide
      UNION ALL SELECT trial_id, fold, split, 'f1@0.5', f1 FROM wide)""",
)
def validate_weighted(spark, sf_dir):
    """Weighted metrics: rows count with the weight of their class, more in later folds."""
    df = split.class_weights(scores(spark, sf_dir))
    found = validate.measures(df.withColumn("weight", F.col("weight") * (F.col("fold") + 1)), _KEYS, _METRICS, weight="weight")
    return found.select(*_KEYS, "metric", r4(F.col("value")).alias("value"))
