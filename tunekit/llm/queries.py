"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.llm import (
    bpe, grid_join, language, line_rules, mixing, oracles, packing, pii, runs, sharding, simhash, spelling, suffix_dedup, warc,
)
from tunekit.llm.common import table
from tunekit.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path, pattern), path)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    ).drop("ids")


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query("op3_warc", oracles.WARC)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_line_rules", oracles.LINE_RULES)
def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_row(pii.find(table(spark, sf_dir, "documents")))


@query("op8_suffix_dedup", oracles.SUFFIX_DEDUP)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.removed(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_grid_join", oracles.GRID_JOIN)
def op1_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_mixing", oracles.MIX)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")


@query("op13_spelling", oracles.VARIANTS)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
