"""Queries over training tables: reading, columns, splits, transforms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tunekit.catalog.registry import query
from tunekit.catalog.views import (
    DOCUMENTS_WIDE,
    FEATURES,
    KEYS,
    TRAIN_MISSING,
    TRAIN_OUTLIER,
    TRAIN_WIDE,
    documents_wide,
    q4,
    r4,
    table,
    train_missing,
    train_outlier,
    train_wide,
    u_sql,
    vectors,
)
from tunekit.functions import arrays
from tunekit.operators import columns, split
from tunekit.operators.evaluate import bucket_scores, correlations, entropy
from tunekit.operators.prep import Clip, Fill, MinMax, Power, QuantileBuckets, Standardize
from tunekit.operators.prep.rbf import cluster_radii, distance_to, rbf_values
from tunekit.sources.readers import as_training_table

_KEYS = ", ".join(KEYS)


def _union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- sources and columns


@query(
    "src_scan_profile",
    f"WITH {TRAIN_MISSING} "
    + _union_sql(
        [
            f"SELECT '{c}' AS feature, count(*)::BIGINT AS n_rows, (count(*) - count({c}))::BIGINT AS n_missing FROM train_missing"
            for c in [*FEATURES, "label"]
        ]
    ),
)
def src_scan_profile(spark, sf_dir):
    df = as_training_table(train_missing(spark, sf_dir), keep=KEYS)
    flat = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(columns.present(c)).alias(c) for c in [*FEATURES, "label"]])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col("n_rows"), (F.col("n_rows") - F.col(c)).alias("n_missing"))
        for c in [*FEATURES, "label"]
    ]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "prep_assemble",
    f"WITH {TRAIN_WIDE} SELECT {_KEYS}, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3, label FROM train_wide",
)
def prep_assemble(spark, sf_dir):
    return _unpacked(columns.assemble(train_wide(spark, sf_dir), FEATURES, keep=KEYS), 4)


def _unpacked(df, n, rounded=False):
    """Feature vector as columns f0.. (plain numbers compare across engines)."""
    arr = df.withColumn("_x", vector_to_array("features"))
    cells = [(r4(F.col("_x")[i]) if rounded else F.col("_x")[i]).alias(f"f{i}") for i in range(n)]
    return arr.select(*KEYS, *cells, "label")


@query("select_columns", f"WITH {TRAIN_WIDE} SELECT l_orderkey, l_quantity, label FROM train_wide")
def select_columns(spark, sf_dir):
    return columns.select_columns(train_wide(spark, sf_dir), ["l_orderkey", "l_quantity", "label"])


@query("select_features", f"WITH {TRAIN_WIDE} SELECT {_KEYS}, l_tax AS f0, l_quantity AS f1, label FROM train_wide")
def select_features(spark, sf_dir):
    df = columns.assemble(train_wide(spark, sf_dir), FEATURES, keep=KEYS)
    return _unpacked(columns.slice_features(df, ["l_tax", "l_quantity"]), 2)


@query(
    "feature_names",
    _union_sql([f"SELECT {i}::INTEGER AS idx, '{c}' AS name, count(*)::BIGINT AS n_rows FROM lineitem" for i, c in enumerate(FEATURES)]),
)
def feature_names(spark, sf_dir):
    return columns.feature_name_table(columns.assemble(train_wide(spark, sf_dir), FEATURES, keep=KEYS))


@query(
    "stat_median",
    f"WITH {TRAIN_MISSING} "
    + _union_sql([f"SELECT '{c}' AS feature, quantile_disc({c}, 0.5) AS median FROM train_missing" for c in FEATURES]),
)
def stat_median(spark, sf_dir):
    df = train_missing(spark, sf_dir)
    found = columns.median(df, FEATURES, rel_error=0)
    return spark.createDataFrame(list(found.items()), "feature string, median double")


@query(
    "stat_basic",
    f"WITH {TRAIN_MISSING} "
    + _union_sql(
        [
            f"SELECT '{c}' AS feature, {q4(f'avg({c})')} AS avg, {q4(f'max({c})')} AS max, {q4(f'min({c})')} AS min, "
            f"(round(sum({c}), 2) + 0.0::DOUBLE) AS sum, count({c})::DOUBLE AS count FROM train_missing"
            for c in FEATURES
        ]
    ),
)
def stat_basic(spark, sf_dir):
    df = columns.statistics_long(train_missing(spark, sf_dir), FEATURES)
    return df.select(
        "feature", *[r4(F.col(c)).alias(c) for c in ("avg", "max", "min")], (F.round("sum", 2) + F.lit(0.0)).alias("sum"), "count"
    )


@query(
    "stat_array_mean",
    f"""SELECT label, (pos - 1)::INTEGER AS pos, {q4('avg(x)')} AS mean FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
    GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY label, pos"),
)
def stat_array_mean(spark, sf_dir):
    return columns.array_mean(vectors(spark, sf_dir), "x", ["label"]).select("label", "pos", r4(F.col("mean")).alias("mean"))


_W = [0.5 + (i % 4) for i in range(64)]
_W_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in _W) + "]"
_VECS = "vecs AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings)"


@query(
    "array_norm",
    f"""WITH {_VECS}, parts AS (
      SELECT vec_id, unnest(x) AS x, unnest({_W_SQL}) AS w FROM vecs)
    SELECT vec_id, {q4('sqrt(sum(x * x))')} AS norm, {q4('sqrt(sum(w * x * w * x))')} AS weighted_norm FROM parts GROUP BY vec_id""",
)
def array_norm(spark, sf_dir):
    x, w = F.col("x"), arrays.lit_array(_W)
    return vectors(spark, sf_dir).select(
        "vec_id", r4(arrays.norm(x)).alias("norm"), r4(arrays.weighted_norm(x, w)).alias("weighted_norm")
    )


@query(
    "array_dot",
    f"""WITH {_VECS}, parts AS (SELECT vec_id, unnest(x) AS x, unnest({_W_SQL}) AS w FROM vecs)
    SELECT vec_id, {q4('sum(x * w)')} AS dot FROM parts GROUP BY vec_id""",
)
def array_dot(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r4(arrays.dot(F.col("x"), arrays.lit_array(_W))).alias("dot"))


@query(
    "array_distance",
    f"""WITH {_VECS}, parts AS (
      SELECT v.vec_id, unnest(v.x) AS x, unnest(c.x) AS y, unnest({_W_SQL}) AS w FROM vecs v, (SELECT x FROM vecs WHERE vec_id = (SELECT min(vec_id) FROM vecs)) c)
    SELECT vec_id, {q4('sqrt(sum((x - y) * (x - y)))')} AS distance, {q4('sqrt(sum(w * w * (x - y) * (x - y)))')} AS weighted_distance
    FROM parts GROUP BY vec_id""",
)
def array_distance(spark, sf_dir):
    df = vectors(spark, sf_dir)
    first = df.agg(F.min_by("x", "vec_id").alias("y")).first()["y"]  # one vector
    x, y = F.col("x"), arrays.lit_array(first)
    return df.select(
        "vec_id",
        r4(arrays.distance(x, y)).alias("distance"),
        r4(arrays.weighted_distance(x, y, arrays.lit_array(_W))).alias("weighted_distance"),
    )


# ---------------------------------------------------------------- splits and balancing


@query(
    "split_ab",
    f"""WITH {TRAIN_WIDE} SELECT {_KEYS}, CASE WHEN {u_sql(KEYS, 'a')} < {3.0 / 4.0}::DOUBLE THEN 'A' ELSE 'B' END AS split FROM train_wide""",
)
def split_ab(spark, sf_dir):
    return split.ab_split(train_wide(spark, sf_dir), 3.0, KEYS).select(*KEYS, "split")


@query(
    "split_kfold",
    f"""WITH {TRAIN_WIDE} SELECT {_KEYS}, floor({u_sql(KEYS, 'f')} * 5.0::DOUBLE)::INTEGER AS fold FROM train_wide""",
)
def split_kfold(spark, sf_dir):
    return split.k_fold(train_wide(spark, sf_dir), 5, KEYS).select(*KEYS, "fold")


@query(
    "balance_downsample",
    f"""WITH {DOCUMENTS_WIDE}, sizes AS (SELECT label, count(*) AS n FROM documents_wide GROUP BY label)
    SELECT doc_id, label FROM documents_wide JOIN sizes USING (label)
    WHERE {u_sql(['doc_id'], 'b')} < (SELECT min(n) FROM sizes)::DOUBLE / n::DOUBLE""",
)
def balance_downsample(spark, sf_dir):
    return split.downsample(documents_wide(spark, sf_dir), key=["doc_id"]).select("doc_id", "label")


@query(
    "balance_weights",
    f"""WITH {DOCUMENTS_WIDE}, sizes AS (SELECT label, count(*) AS n FROM documents_wide GROUP BY label)
    SELECT doc_id, label, {q4('(SELECT sum(n) FROM sizes)::DOUBLE / ((SELECT count(*) FROM sizes) * n)::DOUBLE')} AS weight
    FROM documents_wide JOIN sizes USING (label)""",
)
def balance_weights(spark, sf_dir):
    return split.class_weights(documents_wide(spark, sf_dir)).select("doc_id", "label", r4(F.col("weight")).alias("weight"))


# ---------------------------------------------------------------- wide transforms


def _wide(prep, df):
    out = prep.fit(df).transform(df)
    return out.select(*KEYS, *[r4(F.col(c)).alias(c) for c in out.columns if c not in KEYS and c != "label"], "label")


def _each(fmt: str) -> str:
    return ", ".join(f"{q4(fmt.format(c=c))} AS {c}" for c in FEATURES)


def _stats_sql(cells: str, view: str) -> str:
    return "s AS (SELECT " + ", ".join(cells.format(c=c) for c in FEATURES) + f" FROM {view})"


@query(
    "prep_fill_mean",
    f"""WITH {TRAIN_MISSING}, {_stats_sql('avg({c}) AS m_{c}', 'train_missing')}
    SELECT {_KEYS}, {_each('coalesce({c}, m_{c})')}, label FROM train_missing, s""",
)
def prep_fill_mean(spark, sf_dir):
    return _wide(Fill("mean", features=FEATURES), train_missing(spark, sf_dir))


@query(
    "prep_fill_median",
    f"""WITH {TRAIN_MISSING}, {_stats_sql('quantile_disc({c}, 0.5) AS m_{c}', 'train_missing')}
    SELECT {_KEYS}, {_each('coalesce({c}, m_{c})')}, label FROM train_missing, s""",
)
def prep_fill_median(spark, sf_dir):
    return _wide(Fill("median", rel_error=0, features=FEATURES), train_missing(spark, sf_dir))


@query(
    "prep_clip_mean",
    f"""WITH {TRAIN_OUTLIER}, {_stats_sql('avg({c}) AS m_{c}, 2.5::DOUBLE * stddev_samp({c}) AS r_{c}', 'train_outlier')}
    SELECT {_KEYS}, {_each('least(greatest({c}, m_{c} - r_{c}), m_{c} + r_{c})')}, label FROM train_outlier, s""",
)
def prep_clip_mean(spark, sf_dir):
    return _wide(Clip("mean", 2.5, features=FEATURES), train_outlier(spark, sf_dir))


@query(
    "prep_clip_median",
    f"""WITH {TRAIN_OUTLIER}, {_stats_sql('quantile_disc({c}, 0.5) AS m_{c}, 2.0::DOUBLE * stddev_samp({c}) AS r_{c}', 'train_outlier')}
    SELECT {_KEYS}, {_each('least(greatest({c}, m_{c} - r_{c}), m_{c} + r_{c})')}, label FROM train_outlier, s""",
)
def prep_clip_median(spark, sf_dir):
    return _wide(Clip("median", 2.0, rel_error=0, features=FEATURES), train_outlier(spark, sf_dir))


@query(
    "prep_clip_tukey",
    f"""WITH {TRAIN_OUTLIER}, {_stats_sql('quantile_disc({c}, 0.25) AS a_{c}, quantile_disc({c}, 0.75) AS b_{c}', 'train_outlier')}
    SELECT {_KEYS}, {_each('least(greatest({c}, a_{c} - 1.5::DOUBLE * (b_{c} - a_{c})), b_{c} + 1.5::DOUBLE * (b_{c} - a_{c}))')}, label
    FROM train_outlier, s""",
)
def prep_clip_tukey(spark, sf_dir):
    return _wide(Clip("tukey", 1.5, rel_error=0, features=FEATURES), train_outlier(spark, sf_dir))


@query(
    "prep_power",
    f"""SELECT c_custkey, {q4('pow(c_acctbal, 2.0)')} AS c_acctbal_boxcox_12, {q4('pow(s.c_nationkey + 1.0, -0.5)')} AS nation_boxcox_7
    FROM customer s""",
)
def prep_power(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", (F.col("c_nationkey") + 1.0).alias("nation"), F.lit(0.0).alias("label")
    )
    one = Power(code=12, features=["c_acctbal", "nation"]).fit(df)  # feature 0, exponent 2
    two = Power(feature="nation", exponent=7).fit(df)
    out = two.transform(one.transform(df))
    return out.select("c_custkey", r4(F.col("c_acctbal_boxcox_12")).alias("c_acctbal_boxcox_12"), r4(F.col("nation_boxcox_7")).alias("nation_boxcox_7"))


@query(
    "prep_log",
    f"""SELECT c_custkey, {q4('CASE WHEN c_acctbal <= 0 THEN 0.0::DOUBLE ELSE ln(1.0::DOUBLE + c_acctbal) END')} AS c_acctbal_boxcox_8 FROM customer""",
)
def prep_log(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0.0).alias("label"))
    out = Power(feature="c_acctbal").fit(df).transform(df)
    return out.select("c_custkey", r4(F.col("c_acctbal_boxcox_8")).alias("c_acctbal_boxcox_8"))


_BUCKETS = 5


@query(
    "prep_buckets",
    f"""WITH {TRAIN_OUTLIER}, {_stats_sql(', '.join(f'quantile_disc({{c}}, {i / _BUCKETS}) AS q{i}_{{c}}' for i in range(1, _BUCKETS)), 'train_outlier')}
    SELECT {_KEYS}, {', '.join(FEATURES)}, """
    + ", ".join(
        f"(len(list_filter(list_distinct([{', '.join(f'q{i}_{c}' for i in range(1, _BUCKETS))}]), lambda q: q <= {c})))::DOUBLE AS {c}_rank"
        for c in FEATURES
    )
    + ", label FROM train_outlier, s",
)
def prep_buckets(spark, sf_dir):
    df = train_outlier(spark, sf_dir)
    out = QuantileBuckets(_BUCKETS, rel_error=0, features=FEATURES).fit(df).transform(df)
    return out.select(*KEYS, *FEATURES, *[f"{c}_rank" for c in FEATURES], "label")


# ---------------------------------------------------------------- vector transforms


@query(
    "prep_minmax",
    f"""WITH {TRAIN_WIDE}, {_stats_sql('min({c}) AS a_{c}, max({c}) AS b_{c}', 'train_wide')}
    SELECT {_KEYS}, """
    + ", ".join(
        f"{q4(f'CASE WHEN a_{c} = b_{c} THEN 0.5::DOUBLE ELSE ({c} - a_{c}) / (b_{c} - a_{c}) END')} AS f{i}" for i, c in enumerate(FEATURES)
    )
    + ", label FROM train_wide, s",
)
def prep_minmax(spark, sf_dir):
    df = columns.assemble(train_wide(spark, sf_dir), FEATURES, keep=KEYS)
    return _unpacked(MinMax().fit(df).transform(df), 4, rounded=True)


@query(
    "prep_standardize",
    f"""WITH {TRAIN_WIDE}, {_stats_sql('stddev_samp({c}) AS s_{c}', 'train_wide')}
    SELECT {_KEYS}, """
    + ", ".join(f"{q4(f'CASE WHEN s_{c} = 0 THEN 0.0::DOUBLE ELSE {c} / s_{c} END')} AS f{i}" for i, c in enumerate(FEATURES))
    + ", label FROM train_wide, s",
)
def prep_standardize(spark, sf_dir):
    df = columns.assemble(train_wide(spark, sf_dir), FEATURES, keep=KEYS)
    return _unpacked(Standardize().fit(df).transform(df), 4, rounded=True)


@query(
    "prep_rbf_radius",
    """WITH d AS (
      SELECT label AS cluster, vec_id, unnest(list_transform(embedding, lambda v: v::DOUBLE)) AS x FROM embeddings),
    n AS (SELECT cluster, vec_id, sum(x * x) AS dist FROM d GROUP BY cluster, vec_id),
    r AS (SELECT cluster, max(dist) * 0.2::DOUBLE AS raw FROM n GROUP BY cluster)
    SELECT cluster, (round(CASE WHEN raw > 0 THEN raw ELSE (SELECT coalesce(min(raw), 1.0) FROM r WHERE raw > 0) END, 4) + 0.0::DOUBLE) AS radius FROM r""",
)
def prep_rbf_radius(spark, sf_dir):
    x = F.col("x")
    members = vectors(spark, sf_dir).select(F.col("label").alias("cluster"), distance_to(x, arrays.lit_array([0.0] * 64)).alias("dist"))
    return cluster_radii(members, "dist", 0.2).select("cluster", r4(F.col("radius")).alias("radius"))


@query(
    "prep_rbf_apply",
    f"""WITH {_VECS}, centres AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, x AS c FROM vecs ORDER BY vec_id LIMIT 2),
    parts AS (SELECT v.vec_id, i, unnest(v.x) AS x, unnest(c) AS c FROM vecs v, centres),
    d AS (SELECT vec_id, i, sum((x - c) * (x - c)) AS d2 FROM parts GROUP BY vec_id, i),
    e AS (SELECT vec_id, i, exp(-(d2 * d2) / (2.0::DOUBLE * (CASE i WHEN 1 THEN 150.0 ELSE 100.0 END)::DOUBLE * (CASE i WHEN 1 THEN 150.0 ELSE 100.0 END)::DOUBLE)) AS g FROM d)
    SELECT vec_id, {q4('max(CASE i WHEN 1 THEN g END)')} AS f0, {q4('max(CASE i WHEN 2 THEN g END)')} AS f1 FROM e GROUP BY vec_id""",
)
def prep_rbf_apply(spark, sf_dir):
    df = vectors(spark, sf_dir)
    centres = [r["x"] for r in df.orderBy("vec_id").select("x").limit(2).collect()]
    f0, f1 = rbf_values(F.col("x"), centres, [150.0, 100.0])
    return df.select("vec_id", r4(f0).alias("f0"), r4(f1).alias("f1"))


# ---------------------------------------------------------------- dataset evaluation


@query(
    "eval_corr",
    f"WITH {TRAIN_OUTLIER} "
    + _union_sql([f"SELECT '{c}' AS feature, {q4(f'corr({c}, label)')} AS corr FROM train_outlier" for c in FEATURES]),
)
def eval_corr(spark, sf_dir):
    return correlations(train_outlier(spark, sf_dir), FEATURES).select("feature", r4(F.col("corr")).alias("corr"))


def _parts_sql(view: str) -> str:
    return "parts AS (" + _union_sql(
        [
            f"SELECT '{c}' AS feature, floor({c} / {step}::DOUBLE)::BIGINT AS bucket, label FROM {view}"
            for c, step in _STEPS.items()
        ]
    ) + ")"


_STEPS = {"l_quantity": 5.0, "l_extendedprice": 10000.0, "l_discount": 0.025}


def _bucketed(spark, sf_dir):
    return train_wide(spark, sf_dir).select(*[F.floor(F.col(c) / s).alias(c) for c, s in _STEPS.items()], "label")


@query(
    "eval_entropy",
    f"""WITH {TRAIN_WIDE}, {_parts_sql('train_wide')}, c AS (SELECT feature, bucket, count(*) AS n FROM parts GROUP BY feature, bucket),
    t AS (SELECT feature, sum(n) AS t FROM c GROUP BY feature)
    SELECT feature, {q4('-sum((n / t::DOUBLE) * log2(n / t::DOUBLE))')} AS entropy FROM c JOIN t USING (feature) GROUP BY feature""",
)
def eval_entropy(spark, sf_dir):
    return entropy(_bucketed(spark, sf_dir), list(_STEPS)).select("feature", r4(F.col("entropy")).alias("entropy"))


@query(
    "eval_info_gain",
    f"""WITH {TRAIN_WIDE}, {_parts_sql('train_wide')},
    c AS (SELECT feature, bucket, count(*) AS n, sum(label) AS p FROM parts GROUP BY feature, bucket),
    h AS (SELECT feature, bucket, n, p,
      -(CASE WHEN p > 0 THEN p / n * log2(p / n) ELSE 0.0 END + CASE WHEN n - p > 0 THEN (n - p) / n * log2((n - p) / n) ELSE 0.0 END) AS h FROM c),
    t AS (SELECT feature, sum(n) AS tn, sum(p) AS tp FROM c GROUP BY feature)
    SELECT feature, {q4('max(-(tp / tn * log2(tp / tn) + (tn - tp) / tn * log2((tn - tp) / tn))) - sum(h * n / tn)')} AS info_gain
    FROM h JOIN t USING (feature) GROUP BY feature""",
)
def eval_info_gain(spark, sf_dir):
    return bucket_scores(_bucketed(spark, sf_dir), list(_STEPS)).select("feature", r4(F.col("info_gain")).alias("info_gain"))


