"""Queries over stacked score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunekit.catalog.registry import query
from tunekit.catalog.views import SCORES, q4, r4, scores
from tunekit.operators import validate

_AUC = """counts AS (
  SELECT trial_id, fold, split, score, sum(CASE WHEN label > 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pos, sum(CASE WHEN label > 0.5 THEN 0.0 ELSE 1.0 END)::DOUBLE AS neg
  FROM scores GROUP BY trial_id, fold, split, score),
run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY trial_id, fold, split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts),
aucs AS (SELECT trial_id, fold, split, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) ELSE 0.0 END AS auc,
  sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM run GROUP BY trial_id, fold, split)"""

_KEYS = ["trial_id", "fold", "split"]


@query("validate_auc", f"WITH {SCORES}, {_AUC} SELECT trial_id, fold, split, {q4('auc')} AS auc, n_pos, n_neg FROM aucs")
def validate_auc(spark, sf_dir):
    return validate.auc(scores(spark, sf_dir), _KEYS).select(*_KEYS, r4(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@query(
    "validate_ks",
    f"""WITH {SCORES}, c AS (
      SELECT trial_id, fold, split, score, sum(label) AS pos, sum(1.0::DOUBLE - label) AS neg FROM scores GROUP BY trial_id, fold, split, score),
    r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS p, sum(neg) OVER g AS q FROM c
      WINDOW w AS (PARTITION BY trial_id, fold, split ORDER BY score), g AS (PARTITION BY trial_id, fold, split))
    SELECT trial_id, fold, split, {q4('max(abs(cp / p - cn / q))')} AS ks FROM r GROUP BY trial_id, fold, split""",
)
def validate_ks(spark, sf_dir):
    return validate.ks(scores(spark, sf_dir), _KEYS).select(*_KEYS, r4(F.col("ks")).alias("ks"))


@query(
    "validate_thresholds",
    f"""WITH {SCORES}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
    c AS (SELECT trial_id, split, threshold,
      sum(CASE WHEN score >= threshold AND label > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN score >= threshold AND label <= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
      sum(CASE WHEN label > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label > 0.5 THEN 0 ELSE 1 END)::DOUBLE AS q
      FROM scores, t GROUP BY trial_id, split, threshold)
    SELECT trial_id, split, threshold, {q4('CASE WHEN p > 0 THEN tp / p ELSE 0 END')} AS sensitivity, {q4('CASE WHEN q > 0 THEN (q - fp) / q ELSE 0 END')} AS specificity,
      {q4('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS "precision", {q4('CASE WHEN p + tp + fp > 0 THEN 2 * tp / (p + tp + fp) ELSE 0 END')} AS f1 FROM c""",
)
def validate_thresholds(spark, sf_dir):
    keys = ["trial_id", "split"]
    df = validate.threshold_metrics(scores(spark, sf_dir), keys)
    return df.select(*keys, "threshold", *[r4(F.col(c)).alias(c) for c in ("sensitivity", "specificity", "precision", "f1")])


_PAIRS = """pairs AS (SELECT trial_id, fold, coalesce(max(CASE WHEN split = 'A' THEN auc END), 0) AS x, coalesce(max(CASE WHEN split = 'B' THEN auc END), 0) AS y
  FROM aucs GROUP BY trial_id, fold)"""


def _pairs(spark, sf_dir):
    found = validate.auc(scores(spark, sf_dir), _KEYS)
    return validate.train_test_pairs(found, ["trial_id", "fold"]).withColumn("metric", F.lit("auc"))


_W = (-1.0, 1.0, 0.25, 0.5, 0.75)


@query(
    "validate_blend",
    f"WITH {SCORES}, {_AUC}, {_PAIRS} SELECT trial_id, fold, {q4('-1.0 * x * x + y * y + 0.25 * x * y + 0.5 * x + 0.75 * y')} AS blended FROM pairs",
)
def validate_blend(spark, sf_dir):
    df = validate.blend_metrics(_pairs(spark, sf_dir), {"auc": _W}, ["trial_id", "fold"])
    return df.select("trial_id", "fold", r4(F.col("blended")).alias("blended"))


# fold 0 stands for the final fit, folds 1..4 for the cross-validation
@query(
    "validate_objective",
    f"""WITH {SCORES}, {_AUC}, {_PAIRS},
    v AS (SELECT trial_id, avg(CASE WHEN fold > 0 THEN y * y - x * x END) AS cv, max(CASE WHEN fold = 0 THEN y * y - x * x END) AS final,
      avg(CASE WHEN fold > 0 THEN y END) AS cv2, max(CASE WHEN fold = 0 THEN y END) AS final2 FROM pairs GROUP BY trial_id)
    SELECT trial_id, (round(cv * cv + final * final, 8) + 0.0::DOUBLE) AS squared_gap, {q4('(cv2 + final2) / 2')} AS generalize FROM v""",
)
def validate_objective(spark, sf_dir):
    fold_w, final_w, _ = validate.OBJECTIVES["squared_gap"]
    x, y = F.col("train_value"), F.col("test_value")
    first = F.col("fold") == 0
    df = _pairs(spark, sf_dir).groupBy("trial_id").agg(
        F.avg(F.when(~first, validate.blend(x, y, fold_w))).alias("cv"),
        F.max(F.when(first, validate.blend(x, y, final_w))).alias("final"),
        F.avg(F.when(~first, validate.blend(x, y, validate.OBJECTIVES["generalize"][0]))).alias("cv2"),
        F.max(F.when(first, validate.blend(x, y, validate.OBJECTIVES["generalize"][1]))).alias("final2"),
    )
    return df.select(
        "trial_id",
        (F.round(validate.objective(F.col("cv"), F.col("final"), "squared_gap"), 8) + F.lit(0.0)).alias("squared_gap"),
        r4(validate.objective(F.col("cv2"), F.col("final2"))).alias("generalize"),
    )


@query(
    "score_minmax_probability",
    f"""WITH {SCORES}, b AS (SELECT trial_id, min(margin) AS low, max(margin) AS high FROM scores WHERE split = 'A' AND score BETWEEN 0.1 AND 0.9 GROUP BY trial_id)
    SELECT trial_id, fold, split, {q4('sum(p)')} AS total, {q4('min(p)')} AS least, {q4('max(p)')} AS most, count(*)::BIGINT AS n FROM (
      SELECT s.*, CASE WHEN margin > high THEN 1.0 WHEN margin >= 0 THEN 0.5 * margin / high + 0.5 WHEN margin >= low THEN 0.5 * (low - margin) / low ELSE 0.0 END::DOUBLE AS p
      FROM scores s JOIN b USING (trial_id)) GROUP BY trial_id, fold, split""",
)
def score_minmax_probability(spark, sf_dir):
    df = scores(spark, sf_dir)
    seen = df.filter((F.col("split") == "A") & F.col("score").between(0.1, 0.9))
    both = df.join(validate.margin_range(seen, "margin", ["trial_id"]), "trial_id")
    p = validate.margin_probability(F.col("margin"), F.col("low"), F.col("high"))
    return (
        both.select(*_KEYS, p.alias("p"))
        .groupBy(*_KEYS)
        .agg(r4(F.sum("p")).alias("total"), r4(F.min("p")).alias("least"), r4(F.max("p")).alias("most"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "cv_mean",
    f"""WITH {SCORES}, {_AUC}, {_PAIRS} SELECT trial_id, {q4('avg(y)')} AS cv, count(*)::BIGINT AS n_folds FROM pairs GROUP BY trial_id""",
)
def cv_mean(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("trial_id").agg(r4(F.avg("test_value")).alias("cv"), F.count(F.lit(1)).alias("n_folds"))
