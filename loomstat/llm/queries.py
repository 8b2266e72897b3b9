"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, licences, merges, mixing, neardups, negatives, pieces, quality, search, sharding, tokens, toxicity, vectors


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cover_tree_topk": search.op1,
        "op2_pu_quality": quality.op2,
        "op3_kd_shards": sharding.op3,
        "op4_minhash_neardups": neardups.op4,
        "op5_toxic_segments": toxicity.op5,
        "op6_sentencepiece": pieces.op6,
        "op7_source_mix": mixing.op7,
        "op8_licence_scan": licences.op8,
        "op9_itq_neardups": vectors.op9,
        "op10_token_counts": tokens.op10,
        "op11_ns_clusters": clustering.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_pair_index_bpe": merges.op13,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cover_tree_topk": search.SQL_TOP,
        "op7_source_mix": mixing.SQL,
        "op8_licence_scan": licences.sql(),
        "op9_itq_neardups": vectors.SQL_NEAR,
        "op11_ns_clusters": clustering.sql(),
        "op12_hard_negatives": negatives.SQL,
    }
