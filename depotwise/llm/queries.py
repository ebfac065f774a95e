"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depotwise.llm import bpe, decontamination, maxent_lm, metric_tree, near_dedup, packing, passage_dedup, sharding, spelling_groups, suffix_dedup, toxicity, turn_repair, warc
from depotwise.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`valid` is true where the archive gave back what was written."""
    return warc.archived(table(spark, sf_dir, "pages")).drop("url", "payload")


def op3_compact_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).rows


def op10_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_inner_products(table(spark, sf_dir, "embeddings"))


def op11_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.reports(turn_repair.damaged(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_array_dedup, op2_warc_segments, op3_compact_window_dedup, op4_best_fit_packing, op5_token_counts, op6_toxicity,
        op7_benchmark_decontamination, op8_hilbert_sharding, op9_minhash_near_dedup,
        op10_metric_tree_search, op11_maxent_scores, op12_spelling_variants, op13_conversation_repair,
    )
}
SQL: dict[str, str] = {"op9_minhash_near_dedup": near_dedup.SQL, "op10_metric_tree_search": metric_tree.SQL}
