import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, QuantileDiscretizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tunekit.catalog.views import FEATURES, KEYS, train_missing, train_outlier
from tunekit.operators import columns, split
from tunekit.operators.prep import Clip, Fill, MinMax, Power, QuantileBuckets, RadialBasis, Standardize
from tunekit.operators.prep.rbf import cluster_radii
from tunekit.sources.readers import as_training_table, read_csv


def disc(values, p):
    values = sorted(values)
    return values[max(math.ceil(p * len(values)), 1) - 1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles_against_sorting(spark, seed):
    rng = random.Random(seed)
    kinds = [
        lambda: rng.gauss(0, 1),
        lambda: rng.choice([1.0, 1.0, 1.0, 2.0, -3.0]),
        lambda: rng.random() ** 8 * 1e6,  # crowded at one end
        lambda: 7.0,
    ]
    rows = [tuple(k() for k in kinds) for _ in range(501)]
    rows += [(None, float("nan"), None, float("nan"))] * 20
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    points = [0.001, 0.25, 0.5, 0.75, 0.999]
    got = columns.exact_quantiles(df, ["a", "b", "c", "d"], points, bins=256)
    for i, c in enumerate("abcd"):
        clean = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        assert got[c] == [disc(clean, p) for p in points]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert columns.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}
    assert columns.quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_sketch_quantile_is_close(spark, wide):
    exact = columns.median(wide, ["l_extendedprice"], rel_error=0)["l_extendedprice"]
    rough = columns.median(wide, ["l_extendedprice"], rel_error=0.01)["l_extendedprice"]
    below = wide.filter(F.col("l_extendedprice") <= rough).count() / wide.count()
    assert abs(below - 0.5) < 0.03 and abs(exact - rough) / exact < 0.1


def test_fill_treats_null_and_nan_alike(spark, sf_dir):
    df = train_missing(spark, sf_dir)
    for method in ("mean", "median"):
        out = Fill(method, features=FEATURES).fit(df).transform(df)
        bad = out.filter(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in FEATURES)).count()
        assert bad == 0


def test_mean_fill_uses_the_mean_of_each_column(spark):
    # regression: a statistic must be found under its own column name
    df = spark.createDataFrame([(1.0, 10.0), (3.0, None), (None, 30.0)], "a double, b double")
    rows = Fill("mean", features=["a", "b"]).fit(df).transform(df).collect()
    assert sorted(r["a"] for r in rows) == [1.0, 2.0, 3.0] and sorted(r["b"] for r in rows) == [10.0, 20.0, 30.0]


@pytest.mark.parametrize("method", ["mean", "median", "tukey"])
def test_clip_stays_in_its_band(spark, sf_dir, method):
    df = train_outlier(spark, sf_dir)
    prep = Clip(method, 2.0, features=FEATURES, rel_error=0)
    bands, _ = prep.bands(df, FEATURES)
    out = prep.fit(df).transform(df)
    for c, (low, high) in bands.items():
        r = out.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
        assert low <= r["a"] and r["b"] <= high


def test_clip_keeps_missing_values_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "a double")
    out = [r["a"] for r in Clip("mean", 2.0, features=["a"]).fit(df).transform(df).collect()]
    assert sum(v is None for v in out) == 1 and sum(v is not None and math.isnan(v) for v in out) == 1


def test_clip_does_not_depend_on_column_order_or_type(spark):
    df = spark.createDataFrame([(1.0, 5, 0.1), (0.0, 7, 0.2), (1.0, 900, 0.3)], "label double, n int, x double")
    table = as_training_table(df)
    out = Clip("tukey", 1.0, rel_error=0).fit(table).transform(table)
    assert set(out.columns) == {"n", "x", "label"} and dict(out.dtypes)["n"] == "double"


def test_power_codes_cover_features_times_exponents(spark):
    df = spark.createDataFrame([(4.0, 9.0, 1.0)], "a double, b double, label double")
    got = {}
    for code in range(34):
        fitted = Power(code=code).fit(df)
        row = fitted.transform(df).first().asDict()
        (name,) = [c for c in row if "_boxcox_" in c]
        got[code] = (name, row[name])
    assert got[0][0] == "a_boxcox_0" and got[17][0] == "b_boxcox_0" and got[33][0] == "b_boxcox_16"
    assert got[9][1] == pytest.approx(2.0) and got[26][1] == pytest.approx(3.0)
    assert got[8][1] == pytest.approx(math.log(5.0))


def test_buckets_agree_with_the_stock_discretizer(spark, wide):
    ours = QuantileBuckets(4, rel_error=0, features=["l_extendedprice"]).fit(wide).transform(wide)
    stock = QuantileDiscretizer(inputCol="l_extendedprice", outputCol="q", numBuckets=4, relativeError=0).fit(ours).transform(ours)
    assert stock.filter("q <> l_extendedprice_rank").count() == 0


def test_buckets_give_missing_values_their_own(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),)], "a double")
    out = QuantileBuckets(2, rel_error=0, features=["a"]).fit(df).transform(df)
    assert {r["a_rank"] for r in out.collect()} == {0.0, 1.0, 2.0}


def test_scalers_keep_names_and_range(spark, wide):
    df = columns.assemble(wide, FEATURES, keep=KEYS)
    out = MinMax().fit(df).transform(df)
    assert columns.feature_names(out) == FEATURES
    r = out.select(vector_to_array("features").alias("x")).agg(
        F.min(F.array_min("x")).alias("a"), F.max(F.array_max("x")).alias("b")
    ).first()
    assert (r["a"], r["b"]) == (0.0, 1.0)
    assert columns.feature_names(Standardize().fit(df).transform(df)) == FEATURES
    stock = MinMaxScaler(inputCol="features", outputCol="s").fit(df)
    assert [v for _, k, v in MinMax().fit(df).constants if k == "min"] == list(stock.originalMin)


def test_constant_features(spark):
    df = columns.assemble(spark.createDataFrame([(3.0, 1.0), (3.0, 0.0)], "a double, label double"))
    value = lambda d: {r["x"][0] for r in d.select(vector_to_array("features").alias("x")).collect()}
    assert value(MinMax().fit(df).transform(df)) == {0.5}
    assert value(Standardize().fit(df).transform(df)) == {0.0}


def test_disabled_transform_is_the_identity(spark, wide):
    df = wide.select(*FEATURES, "label")
    out = Clip("mean", 2.0, enabled=False).fit(df).transform(df)
    assert out.columns == df.columns and out.exceptAll(df).count() == 0


def test_transforms_work_in_a_pipeline(spark, wide):
    df = wide.select(*FEATURES, "label")
    model = Pipeline(stages=[Fill("mean"), Clip("mean", 2.0)]).fit(df)
    assert model.transform(df).count() == df.count()


def test_fitted_stages_do_what_transform_does(spark, wide):
    df = wide.select(*FEATURES, "label").limit(200).persist()
    for prep in (Fill("mean"), Clip("tukey", 1.5), Power(code=5), QuantileBuckets(3)):
        fitted = prep.fit(df)
        want = fitted.transform(df)
        got = df
        for stage in fitted.stages():
            got = stage.transform(got)
        assert got.select(*want.columns).exceptAll(want).count() == 0
    df.unpersist()


def test_fit_on_training_rows_only(spark):
    train = columns.assemble(spark.createDataFrame([(0.0, 1.0), (10.0, 0.0)], "a double, label double"))
    test = columns.assemble(spark.createDataFrame([(20.0, 1.0)], "a double, label double"))
    out = MinMax().fit(train).transform(test).select(vector_to_array("features").alias("x")).first()
    assert out["x"] == [2.0]  # outside [0, 1]: nothing is clamped


def test_stats_table(spark, wide):
    t = Clip("mean", 2.0, features=["l_tax"]).fit(wide).stats(spark)
    assert {r["key"] for r in t.collect()} == {"mean", "stddev"}


def test_rbf_radii(spark):
    df = spark.createDataFrame([(0, 4.0), (0, 2.0), (1, 0.0), (2, 9.0)], "cluster int, dist double")
    got = {r["cluster"]: r["radius"] for r in cluster_radii(df, "dist", 0.5).collect()}
    assert got == {0: 2.0, 1: 2.0, 2: 4.5}
    zero = spark.createDataFrame([(0, 0.0)], "cluster int, dist double")
    assert cluster_radii(zero, "dist", 0.5).first()["radius"] == 1.0


@pytest.mark.parametrize("mode", ["sq", "l2"])
def test_rbf_values(spark, mode):
    rows = [(float(i % 3) * 10 + i * 0.1, float(i % 3), float(i % 2)) for i in range(60)]
    df = columns.assemble(spark.createDataFrame(rows, "a double, b double, label double"))
    fitted = RadialBasis(k=3, max_iter=10, ratio=0.5, mode=mode).fit(df)
    out = fitted.transform(df)
    assert columns.feature_names(out) == ["0", "1", "2"]
    x = df.select(vector_to_array("features").alias("x"), "label").first()["x"]
    got = out.select(vector_to_array("features").alias("x")).first()["x"]
    for c, r, v in zip(fitted.centres, fitted.radii, got):
        d2 = sum((a - b) ** 2 for a, b in zip(x, c))
        d = d2 if mode == "sq" else math.sqrt(d2)
        assert v == pytest.approx(math.exp(-d * d / (2 * r * r)), abs=1e-12)
    wide = spark.createDataFrame(rows, "a double, b double, label double")
    assert list(wide.selectExpr(*fitted.cells(["a", "b"])).first()) == pytest.approx(got)


def test_scaler_cells_repeat_the_scaler(spark, wide):
    df = columns.assemble(wide, FEATURES, keep=KEYS)
    for prep in (MinMax(), Standardize(), Standardize(with_mean=True)):
        fitted = prep.fit(df)
        want = fitted.transform(df).orderBy(*KEYS).select(vector_to_array("features").alias("x")).first()["x"]
        got = wide.orderBy(*KEYS).selectExpr(*fitted.cells(FEATURES)).first()
        assert list(got) == pytest.approx(list(want), abs=1e-12)


def test_slicing_keeps_order_and_rejects_nonsense(spark, wide):
    df = columns.assemble(wide, FEATURES, keep=KEYS)
    cut = columns.slice_features(df, ["l_tax", "l_quantity"])
    assert columns.feature_names(cut) == ["l_tax", "l_quantity"] and cut.columns == df.columns
    with pytest.raises(ValueError):
        columns.slice_features(df, [])
    with pytest.raises(ValueError):
        columns.slice_features(df, ["nope"])


def test_splits_do_not_depend_on_partitioning(spark, wide):
    a = split.k_fold(split.ab_split(wide, 1.0, KEYS), 5, KEYS)
    b = split.k_fold(split.ab_split(wide.repartition(7, "l_suppkey"), 1.0, KEYS), 5, KEYS)
    assert a.exceptAll(b).count() == 0
    folds = {r["fold"]: r["count"] for r in a.groupBy("fold").count().collect()}
    assert set(folds) == set(range(5)) and sum(folds.values()) == wide.count()


def test_equal_rows_stay_on_one_side(spark):
    df = spark.createDataFrame([(i % 7, float(i % 7)) for i in range(700)], "k int, x double")
    for out in (split.ab_split(df, key=["k"]), split.ab_split(df, portable=False)):
        assert out.groupBy("k").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_downsampling_balances(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 10 else 0.0) for i in range(5000)], "k int, label double")
    n = split.class_counts(split.downsample(df, key=["k"]))
    assert n[0.0] == 500 and abs(n[1.0] - 500) < 100
    w = split.class_weights(df).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert len({round(r["w"], 6) for r in w}) == 1


def test_csv_reader(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,label\n1,2.5,1\n3,,0\n")
    df = as_training_table(read_csv(spark, str(path)))
    assert [t for _, t in df.dtypes] == ["double"] * 3 and df.count() == 2
    typed = read_csv(spark, str(path), "a double, b double, label double")
    assert typed.filter("b IS NULL").count() == 1
    with pytest.raises(ValueError):
        as_training_table(df.drop("label"))


def test_exact_quantiles_of_infinite_and_far_values(spark):
    inf = float("inf")
    rng = random.Random(9)
    values = [inf] * 3 + [-inf] * 2 + [1.7e308, -1.7e308, 5e-324, 0.0, -0.0] + [rng.gauss(0, 1e-300) for _ in range(40)] + [rng.gauss(0, 1) for _ in range(51)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    points = [0.0, 0.01, 0.02, 0.05, 0.25, 0.5, 0.75, 0.97, 0.98, 1.0]
    ranked = sorted(values)
    expected = [ranked[min(max(math.ceil(p * len(values)), 1), len(values)) - 1] for p in points]
    assert columns.exact_quantiles(df, ["a"], points) == {"a": expected}


def test_bucket_precision_follows_the_count(spark):
    df = spark.range(20000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("label"))
    done = QuantileBuckets(1000, rel_error=0.01).fit(df)
    assert done.transform(df).select("x_rank").distinct().count() == 1000


def test_select_columns_takes_one_name_and_dotted_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`a.b` double, c double")
    assert columns.select_columns(df, ["a.b"]).columns == ["a.b"]
    assert columns.exact_quantiles(df.withColumnRenamed("a.b", "ab"), ["ab"], [0.5]) == {"ab": [1.0]}
    with pytest.raises(ValueError):
        columns.select_columns(df, [])


@pytest.mark.parametrize("mode", ["sq", "l2"])
def test_many_centres_are_one_expression(spark, tmp_path, mode):
    import re as _re

    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tunekit.operators.prep.rbf import FittedRbf, rbf_values

    rng = random.Random(3)
    centres = [[rng.random(), rng.random() * 5, -rng.random()] for _ in range(2000)]
    radii = [0.1 + rng.random() for _ in centres]
    fitted = FittedRbf([], centres, radii, mode)
    rows = [(i, [rng.random(), rng.random() * 5, -rng.random()]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    out = fitted.transform(df.select("id", "x", array_to_vector("x").alias("features")))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert len(_re.findall(r"\bexp\(", plan.lower())) == 1
    got = {r["id"]: r["v"] for r in out.select("id", vector_to_array("features").alias("v")).collect()}
    some = [0, 777, 1999]
    plain = df.select("id", *[c.alias(f"v{i}") for i, c in zip(some, rbf_values(F.col("x"), [centres[i] for i in some], [radii[i] for i in some], mode))])
    for r in plain.collect():
        assert [got[r["id"]][i] for i in some] == pytest.approx([r[f"v{i}"] for i in some], rel=1e-12)
    inputs = ["a", "b c", "d"]
    cells = ", ".join(f"{e} AS r{i}" for i, e in enumerate(fitted.cells(inputs, "all_")))
    stages = [
        SQLTransformer(statement=f"SELECT *, {fitted.prelude(inputs)} AS all_ FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__"),
        VectorAssembler(inputCols=[f"r{i}" for i in range(2000)], outputCol="features"),
    ]
    PipelineModel(stages).write().overwrite().save(f"{tmp_path}/rbf")
    wide = df.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b c"), F.col("x")[2].alias("d"))
    saved = PipelineModel.load(f"{tmp_path}/rbf").transform(wide).select("id", vector_to_array("features").alias("v"))
    assert {r["id"]: r["v"] for r in saved.collect()} == got
