"""The registered queries of the corpus operators: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from maskloom.llm import ann, bytebpe, chat, embedding_dedup, hmm, line_dedup, near_dedup, packing, token_files, toxicity
from maskloom.llm.common import crc_mod, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytebpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), bytebpe.digest_row, bytebpe.DIGESTS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs, removed_col="n_removed").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_removed")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, fresh_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, manifest, with_ids=False)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, model, ["doc_id"])
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    "op1_hmm": op1_hmm,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_chat": op3_chat,
    "op4_ann": op4_ann,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_files": op7_token_files,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": embedding_dedup.ORACLE, "op3_chat": chat.ORACLE, "op6_line_dedup": line_dedup.oracle()}
