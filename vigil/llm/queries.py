"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import ann, fim, licenses, lines, lm, mixing, packing, quality, secrets, sharding, simhash, warc, whitening
from vigil.llm.common import table


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.index(vectors), vectors.filter(F.col("vec_id") % 50 == 0))


MIX_ENTROPY = 0.997  # of the entropy of equal weights


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = mixing.Target(entropy=MIX_ENTROPY, budget=1.0)
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), target)
    return mixed.select("doc_id", "source", F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"),
                        F.col("_block").alias("block"), F.col("_block_rank").alias("block_rank"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"), "problem")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_vocabulary())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


LM_ORDER = 3  # trigrams


def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), order=LM_ORDER)
    return found.withColumn("log_score", F.round("log_score", 6))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.measure(docs, references=quality.learn(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.per_component(table(spark, sf_dir, "embeddings"))


SHARDS = 40


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(sharding.text_sizes(table(spark, sf_dir, "documents")), SHARDS)
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_graph_ann, op2_source_mixing, op3_warc, op4_line_dedup, op5_best_fit_packing, op6_license_scan, op7_secret_scan, op8_backoff_scores, op9_simhash, op10_quality_rules,
                           op11_whitening, op12_feistel_shards, op13_fill_in_middle)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": mixing.oracle_sql(MIX_ENTROPY),
    "op3_warc": warc.oracle_sql(),
    "op4_line_dedup": lines.oracle_sql(),
    "op6_license_scan": licenses.oracle_sql(),
    "op8_backoff_scores": lm.oracle_sql(LM_ORDER),
    "op12_feistel_shards": sharding.oracle_sql(SHARDS),
    "op13_fill_in_middle": fim.oracle_sql(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
