"""Samples and ordered filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stride_sample(positions: DataFrame, most: int) -> DataFrame:
    """Every step-th opcode of a binary, most of them at most; step = length div most, one at least."""
    size = positions.groupBy("binary").agg((F.max("pos") + 1).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return positions.join(size, "binary").where((F.col("pos") % step == 0) & (F.col("pos") / step < most)).select("binary", "pos", "opcode")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order: an aggregate with partial results, so a key with many rows does not meet in one task."""
    names = rows.columns
    best = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(order)).alias("r"))
    return best.select("r.*").select(*names)


def importance(positions: DataFrame) -> DataFrame:
    """Adds weight: threefold for each function boundary within five opcodes, 1.5-fold where the opcode changes, 1.2-fold in diverse stretches of twenty."""
    order = Window.partitionBy("binary").orderBy("pos")
    rows = positions.withColumn("boundary", (F.col("func") != F.lag("func").over(order)).cast("int"))
    near = F.sum(F.coalesce("boundary", F.lit(0))).over(order.rowsBetween(-5, 5))
    rows = rows.withColumn("near", near).withColumn("change", F.col("opcode") != F.lag("opcode").over(order))
    diverse = F.size(F.collect_set("opcode").over(order.rowsBetween(0, 19))) / 20 > 0.7
    weight = F.pow(F.lit(3.0), "near") * F.when(F.col("change"), 1.5).otherwise(1.0) * F.when(diverse, 1.2).otherwise(1.0)
    return rows.withColumn("weight", weight).select("binary", "func", "pos", "opcode", "weight")


def weighted_sample(rows: DataFrame, most: int, seed: str = "42") -> DataFrame:
    """most rows of each binary without replacement, by weight: the largest keys ln(u)/weight (Efraimidis and Spirakis), u from a hash."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "binary", F.col("pos").cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297
    key = F.log(u) / F.col("weight")
    r = F.row_number().over(Window.partitionBy("binary").orderBy(F.desc("key"), "pos"))
    return rows.withColumn("key", key).withColumn("r", r).where(F.col("r") <= most).drop("key", "r")
