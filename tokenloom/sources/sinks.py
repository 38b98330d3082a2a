"""Sequence files, result tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """A folder of <binary>.txt, one opcode a line, blank lines dropped, as functions."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("binary"), "value")
    ops = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return whole.select("binary", F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("func"), ops.alias("ops")).where(F.size("ops") > 0)


def write_result(df: DataFrame, path: str, form: str = "parquet") -> None:
    """One table for each result; json writes a document a row, empty fields included."""
    if form == "json":
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").format(form).save(path)
