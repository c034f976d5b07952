"""Corpus stages: each takes (spark, docs, sf_dir) and works on all rows of ``docs``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import line_dedup, near_dedup, packing, toxicity
from maskloom.llm.common import crc_mod

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; labels are learnt as in the toxicity query.

    Null and empty texts have the score of no evidence, so they stay; repeated rows stay or go alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model, ["row"], "score")
    return scored.filter(F.col("score") < TOXIC).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def cut_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of any length that spread over sites; n_chars, if there, follows the text (null: null)."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of smallest doc_id, of each class of near copies; repeated rows of one doc_id are such copies.

    Rows without words link with nothing, so they stay; a null doc_id comes after all others.
    """
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all rows; null and empty texts are one end id, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_spread_lines), ("near_dedup", keep_one_of_near_copies), ("packing", pack)]
