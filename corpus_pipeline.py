"""A corpus-cleaning pipeline of the training-data operators, each stage written and read again by its runner."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from tokenloom.llm.common import shared_dir

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: Hash functions, sampling and merges are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and reread as the next one's."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
