import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tunekit.catalog.views import scores
from tunekit.operators import validate


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return 0.0
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ks(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return max(abs(sum(s <= t for s in pos) / len(pos) - sum(s <= t for s in neg) / len(neg)) for t, _ in rows)


def _scored(kind, n=300, seed=5):
    rng = random.Random(seed)
    draw = {
        "unit": rng.random,
        "tied": lambda: rng.randrange(5) / 5,
        "wide": lambda: rng.gauss(0, 50),  # mostly outside [0, 1]
        "crowded": lambda: 0.5 + rng.random() * 1e-9,
    }[kind]
    return [(draw(), float(rng.random() < 0.4)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["unit", "tied", "wide", "crowded"])
def test_auc_and_ks_against_all_pairs(spark, kind):
    rows = _scored(kind)
    df = spark.createDataFrame([(g, s, y) for g in (1, 2) for s, y in (rows if g == 1 else rows[:40])], "g int, score double, label double")
    got = {r["g"]: r["auc"] for r in validate.auc(df, ["g"]).collect()}
    ks = {r["g"]: r["ks"] for r in validate.ks(df, ["g"]).collect()}
    for g, part in ((1, rows), (2, rows[:40])):
        assert got[g] == pytest.approx(brute_auc(part), abs=1e-12)
        assert ks[g] == pytest.approx(brute_ks(part), abs=1e-12)


def test_auc_of_the_mirrored_score(spark, sf_dir):
    df = scores(spark, sf_dir)
    a = validate.auc(df, ["split"]).collect()
    b = validate.auc(df.withColumn("score", 1.0 - F.col("score")), ["split"]).collect()
    for x in a:
        (y,) = [r for r in b if r["split"] == x["split"]]
        assert x["auc"] + y["auc"] == pytest.approx(1.0)


def test_auc_equals_the_exact_evaluator(spark, sf_dir):
    df = scores(spark, sf_dir).filter("split = 'A'").withColumn("split", F.lit("A"))
    ours = validate.auc(df, ["split"]).first()["auc"]
    stock = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert ours == pytest.approx(stock, abs=1e-9)


def test_auc_of_one_class_is_zero(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.7, 1.0)], "g int, score double, label double")
    assert validate.auc(df, ["g"]).first()["auc"] == 0.0


def test_hot_group_is_spread_over_parts(spark):
    df = spark.range(200000).select(F.lit(1).alias("g"), F.rand(3).alias("score"), (F.rand(4) < 0.5).cast("double").alias("label"))
    parts = validate.score_counts(df, ["g"]).groupBy("d1", "d2").count()
    top = parts.agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert top["m"] < 50 and top["n"] > 100000


def test_margin_probability(spark):
    df = spark.createDataFrame([(m,) for m in (-5.0, -2.0, -1.0, 0.0, 1.0, 4.0, 9.0)], "m double")
    p = [r["p"] for r in df.select(validate.margin_probability(F.col("m"), -2.0, 4.0).alias("p")).collect()]
    assert p == pytest.approx([0.0, 0.0, 0.25, 0.5, 0.625, 1.0, 1.0])


def test_margin_probability_without_one_side(spark):
    # all training margins negative (or all positive): no division by zero, no probability 1 for a negative margin
    df = spark.createDataFrame([(-3.0,), (-0.5,), (0.5,)], "m double")
    p = [r["p"] for r in df.select(validate.margin_probability(F.col("m"), -2.0, -1.0).alias("p")).collect()]
    assert p == pytest.approx([0.0, 0.375, 0.5])
    p = [r["p"] for r in df.select(validate.margin_probability(F.col("m"), 0.0, 0.0).alias("p")).collect()]
    assert p == pytest.approx([0.5, 0.5, 0.5])


def test_objective_presets(spark):
    row = spark.range(1).select(
        validate.objective(F.lit(0.8), F.lit(0.9)).alias("g"), validate.objective(F.lit(0.8), F.lit(0.9), "squared_gap").alias("s")
    ).first()
    assert row["g"] == pytest.approx(0.85) and row["s"] == pytest.approx(0.64 + 0.81)


@pytest.mark.parametrize("scale", [1.0, 1e-7, -1e9])
def test_hot_group_is_spread_at_any_scale(spark, scale):
    rows = spark.range(60000).select(F.lit(1).alias("g"), (F.rand(3) * scale).alias("score"), (F.rand(4) < 0.5).cast("double").alias("label"))
    counts = validate.score_counts(rows, ["g"])
    assert counts.groupBy("d1", "d2").count().agg(F.max("count")).first()[0] < 600
    order = [(r["d1"], r["d2"]) for r in counts.orderBy("score").collect()]
    assert order == sorted(order)
