"""From raw documents to mixed, sharded training text: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import unused_name, written
from wayspan.llm.decontamination import decontaminate
from wayspan.llm.mixing import mixed_documents
from wayspan.llm.neardup import drop_near_duplicates
from wayspan.llm.quality import drop_low_quality
from wayspan.llm.sharding import assign_shards

#: Token budget of the mixture as a share of the tokens that reach it (an upper limit: less is kept where more would
#: miss the targets), and how far source, language and topic
#: shares are flattened (1 leaves them as they are).
MIX_BUDGET, MIX_ALPHA = 0.95, 0.9
SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = unused_name(docs, "row")  # carries the columns through, whatever they are called
    mixed = mixed_documents(docs.withColumn(row, F.struct(*docs.columns)), alpha=MIX_ALPHA, budget=MIX_BUDGET, calibrated=True)
    return mixed.where("sampled").select(f"{row}.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs, SHARDS)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Registers and sampling by hashes have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None
