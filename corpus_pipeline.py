"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination,
mixing to target weights, token files.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes to the shared folder and reads again as the next stage's
documents. Every stage works on all rows its predecessor kept. The first four return the
columns of ``documents``:

- quality: rows that the quality rules reject go;
- near_duplicates: one row of each group of 5-word-shingle similarity 0.8 or more stays;
- decontaminate: rows that hold a benchmark passage go;
- mix: rows as often as the mix takes whole copies of them (not at all, once or twice);
- tokens: the rest is tokenised into files; the result reports them as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, mixing, neardup, quality, token_files
from tallyframe.llm._store import stored
from tallyframe.llm.queries import TOKENIZER

#: No stage but the first can be put in SQL as a whole; tests hold them to brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontaminate", decontamination_stage),
          ("mix", mix_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
