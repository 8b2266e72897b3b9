"""A training-data pipeline over ``documents``: quality, toxicity, near-duplicates, source mix, pieces.

Each stage takes what the one before kept and returns the columns of documents; the last returns what encoding gives.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import common, mixing, neardups, pieces, quality, toxicity

#: Ids that are broadcast at most to leave rows out; more are met by a shuffle.
BROADCAST_IDS = 2_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go.

    Null and empty texts and null ids are scored like all others; equal texts stay or go together; without positive
    labels, or without unlabelled rows, nothing goes. An empty table stays empty; further columns are passed on.
    """
    rows = quality.featured(docs, docs.columns)
    model = quality.train(rows, common.table(spark, sf_dir, "labels"))
    return rows.where(quality.probability(model)("_x") >= 0.5).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go.

    Null and empty texts have no toxic passage; equal texts stay or go together; without labels nothing goes. An empty
    table stays empty; further columns are passed on.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.judged(docs, model).where("_toxic.score < 0.7").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.8 on five-word shingles the one with the smallest id stays.

    Rows that share a doc_id are one document and stay or go together; rows without one, and texts without words, stay.
    An empty table stays empty; further columns are passed on.
    """
    gone = common.written(neardups.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: rows as often as they are taken, the last of a source cut at its budget.

    Null and empty texts have no words and are never taken; a null source is a source of its own; equal rows are taken
    alike, so they may exceed a budget by their own words. An empty table stays empty; further columns are passed on.
    """
    return mixing.mixed_documents(docs, mixing.cycling())


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row encoded and decoded: one row for each row of the mix, repeated ones too. A null text is an empty one."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]

#: Model fits, similarity joins and merges of a vocabulary are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them rows are written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
