"""Input views over the test tables, written once for Spark and once as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.functions.draws import uniform
from tunekit.sources.readers import spread

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column) -> Column:
    """Rounded to 4 places, without a negative zero: comparable across engines."""
    return F.round(c, 4) + F.lit(0.0)


def q4(expr: str) -> str:
    return f"(round({expr}, 4) + 0.0::DOUBLE)"


def u_sql(keys: Sequence[str], salt: str) -> str:
    args = ", ".join([*[f"({k})::VARCHAR" for k in keys], f"'{salt}'"])
    return f"((('0x' || substr(md5(concat_ws(',', {args})), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def n_sql(keys: Sequence[str], salt: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({u_sql(keys, salt + '/r')})) * cos(2.0::DOUBLE * pi() * {u_sql(keys, salt + '/a')}))"


def train_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = uniform(KEYS, "n")
    score = F.col("l_quantity") / 50.0 + 5.0 * F.col("l_discount") + 0.3 * (noise - 0.5)
    label = F.when(score > 0.75, 1.0).otherwise(0.0).alias("label")
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES)
    # the test file is one row group, so one core would do all; a file with splits for every core is read as it lies
    cores = spark.sparkContext.defaultParallelism
    rows = spread(rows, cores if rows.rdd.getNumPartitions() < cores else None)
    return rows.select(*KEYS, *FEATURES, label)


TRAIN_WIDE = f"""train_wide AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    CASE WHEN l_quantity / 50.0::DOUBLE + 5.0::DOUBLE * l_discount + 0.3::DOUBLE * ({u_sql(KEYS, 'n')} - 0.5::DOUBLE) > 0.75::DOUBLE
      THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM lineitem)"""


def train_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = uniform(KEYS, "m")
    nothing = F.lit(None).cast("double")
    return (
        train_wide(spark, sf_dir)
        .withColumn("l_discount", F.when(m < 0.1, nothing).otherwise(F.col("l_discount")))
        .withColumn("l_tax", F.when((m >= 0.1) & (m < 0.2), F.lit(float("nan"))).otherwise(F.col("l_tax")))
    )


# NaN is written as NULL here: both count as missing
TRAIN_MISSING = f"""{TRAIN_WIDE}, train_missing AS (
  SELECT * REPLACE (
    CASE WHEN m < 0.1::DOUBLE THEN NULL ELSE l_discount END AS l_discount,
    CASE WHEN m >= 0.1::DOUBLE AND m < 0.2::DOUBLE THEN NULL ELSE l_tax END AS l_tax)
  FROM (SELECT *, {u_sql(KEYS, 'm')} AS m FROM train_wide))"""


def train_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    wild = uniform(KEYS, "o") < 0.01
    price = F.col("l_extendedprice")
    return train_wide(spark, sf_dir).withColumn("l_extendedprice", F.when(wild, price * 100.0).otherwise(price))


TRAIN_OUTLIER = f"""{TRAIN_WIDE}, train_outlier AS (
  SELECT * REPLACE (CASE WHEN {u_sql(KEYS, 'o')} < 0.01::DOUBLE THEN l_extendedprice * 100.0::DOUBLE ELSE l_extendedprice END AS l_extendedprice)
  FROM train_wide)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as a log of hyper-parameter trials, one study per user."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("study_id"),
        F.col("event_id").alias("trial_id"),
        "ts",
        F.col("event_type").alias("strategy"),
        F.array(k, F.col("value"), F.hour("ts").cast("double")).alias("params"),
        (F.col("value") / 500.0).alias("objective"),
    )


# p1..p3 are the three parameters
TRIALS = """trials AS (
  SELECT user_id AS study_id, event_id AS trial_id, ts, event_type AS strategy,
    json_extract_string(props, '$.k')::DOUBLE AS p1, value AS p2, hour(ts)::DOUBLE AS p3, value / 500.0::DOUBLE AS objective
  FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked scores of several trials: (trial_id, fold, split, score, margin, label)."""
    score = F.col("l_quantity") / 50.0
    return train_wide(spark, sf_dir).select(
        F.col("l_linenumber").alias("trial_id"),
        F.floor(5.0 * uniform(KEYS, "f")).cast("int").alias("fold"),
        F.when(uniform(KEYS, "a") < 0.5, "A").otherwise("B").alias("split"),
        score.alias("score"),
        (score - 0.5).alias("margin"),
        "label",
    )


SCORES = f"""{TRAIN_WIDE}, scores AS (
  SELECT l_linenumber AS trial_id, floor(5.0::DOUBLE * {u_sql(KEYS, 'f')})::INTEGER AS fold,
    CASE WHEN {u_sql(KEYS, 'a')} < 0.5::DOUBLE THEN 'A' ELSE 'B' END AS split,
    l_quantity / 50.0::DOUBLE AS score, l_quantity / 50.0::DOUBLE - 0.5::DOUBLE AS margin, label
  FROM train_wide)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label"
    )


def documents_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text measures with a naturally unbalanced label."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.length("text").cast("double").alias("n_len"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return docs.join(labels, "doc_id")


DOCUMENTS_WIDE = """documents_wide AS (
  SELECT doc_id, n_chars::DOUBLE AS n_chars, length(text)::DOUBLE AS n_len,
    len(string_split(text, ' '))::DOUBLE AS n_words, quality::DOUBLE AS label
  FROM documents JOIN labels USING (doc_id))"""
