"""The corpus pipeline: toxicity, line dedup, near dedup, packing; every stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm.common import fresh_path
from maskloom.llm.stages import STAGES

#: Packing and near dedup have no form in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
