"""The registered queries of the operators: each applies one operator, with
production parameters, to its whole table. SQL (DuckDB) stands beside the query
where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from funnelkit.llm import line_dedup as lines
from funnelkit.llm import clusters, quality, secret_scan, sql, topk
from funnelkit.llm.bpe import bpe_round_trip
from funnelkit.llm.fingerprints import document_fingerprints
from funnelkit.llm.packing import pack_power_of_two
from funnelkit.llm.repair import repair_conversations
from funnelkit.llm.simhash import simhash_near_dedup
from funnelkit.llm.token_counts import token_counts
from funnelkit.llm.url_filter import judge_urls
from funnelkit.llm.warc import warc_round_trip
from funnelkit.sources.tables import load

# The URL rules of the contract, and hosts blocked with all below them.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("cheap-pills", "spam-farm") for top in ("com", "net", "org")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(load(spark, sf_dir, "documents"))


@query("op3_warc", sql.warc_sql())
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(load(spark, sf_dir, "pages"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_power_of_two(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                             with_ids=False)


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_quality_rules", sql.quality_sql(quality.MAX_RATE))
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"))


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(load(spark, sf_dir, "documents"))


@query("op8_url_filter", sql.url_sql(URL_RULES, BLOCKED_HOSTS))
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


@query("op9_secret_scan", sql.secret_sql(secret_scan.COPIED))
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(load(spark, sf_dir, "documents"))


@query("op10_line_dedup", sql.line_sql(lines.RATIO, lines.MIN_PAGES))
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(load(spark, sf_dir, "documents"), count="n_dropped")


@query("op11_centroid_clusters", sql.cluster_sql(clusters.CENTROIDS, clusters.ROUNDS, clusters.DIM, clusters.SCALE))
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(load(spark, sf_dir, "embeddings"))


@query("op12_top_k", sql.top_k_sql(topk.K, topk.EVERY, topk.SCALE))
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"))


@query("op13_conversation_repair", sql.repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(load(spark, sf_dir, "conversations"))
