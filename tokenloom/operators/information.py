"""Sliding entropy, mutual information, coverage, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy
from ..sources.corpus import prefixes

CAP = 50_000


def sliding_entropy(positions: DataFrame, window: int) -> DataFrame:
    """binary, start, middle, entropy of each whole window of so many opcodes, a quarter of it apart. Each opcode goes to its four or so windows; no range join."""
    step = max(1, window // 4)
    size = positions.groupBy("binary").agg((F.max("pos") + 1).alias("n"))
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - (window - 1)) / step)).cast("long")
    rows = positions.select("binary", "pos", "opcode", F.explode(F.sequence(low, F.floor(F.col("pos") / step).cast("long"))).alias("w"))
    counts = rows.groupBy("binary", "w", "opcode").agg(F.count("*").alias("count"))
    each = counts.groupBy("binary", "w").agg(entropy().alias("entropy")).join(size, "binary").where(F.col("w") * step + window <= F.col("n"))
    return each.select("binary", (F.col("w") * step).alias("start"), (F.col("w") * step + window // 2).alias("middle"), "entropy")


def thin(rows: DataFrame, most: int = 500) -> DataFrame:
    """Above most points in a binary, every (n div most)-th."""
    n = F.count("*").over(Window.partitionBy("binary"))
    r = F.row_number().over(Window.partitionBy("binary").orderBy("start")) - 1
    return rows.withColumn("n", n).withColumn("r", r).where((F.col("n") <= most) | (F.col("r") % F.floor(F.col("n") / most) == 0)).drop("n", "r")


def mutual_information(functions: DataFrame, lags: int, cap: int = CAP, least: int = 10) -> DataFrame:
    """binary, lag, mi in bits, for lags up to half of the binary's first cap opcodes. Pairs come from arrays of at most cap opcodes."""
    rows = prefixes(functions, cap).where(F.size("ops") >= least)
    most = F.least(F.lit(lags), F.floor(F.size("ops") / 2).cast("int"))
    rows = rows.select("binary", "ops", F.explode(F.sequence(F.lit(1), most)).alias("lag"))
    pair = F.arrays_zip(F.expr("slice(ops, 1, size(ops) - lag)").alias("x"), F.expr("slice(ops, lag + 1, size(ops) - lag)").alias("y"))
    joint = rows.select("binary", "lag", F.inline(pair)).toDF("binary", "lag", "x", "y").groupBy("binary", "lag", "x", "y").agg(F.count("*").alias("c"))
    over = lambda *by: F.sum("c").over(Window.partitionBy("binary", "lag", *by))
    joint = joint.withColumn("n", over()).withColumn("cx", over("x")).withColumn("cy", over("y"))
    return joint.groupBy("binary", "lag").agg(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))


def decay(mi: DataFrame) -> DataFrame:
    """binary, initial, final, decay_rate, half_life (the first lag at half of the first value, or null)."""
    s = mi.groupBy("binary").agg(F.min_by("mi", "lag").alias("initial"), F.max_by("mi", "lag").alias("final"))
    half = mi.join(s.select("binary", "initial"), "binary").groupBy("binary").agg(F.min(F.when(F.col("mi") <= F.col("initial") / 2, F.col("lag"))).alias("half_life"))
    rate = F.when(F.col("initial") > 0, (F.col("initial") - F.col("final")) / F.col("initial")).otherwise(0.0)
    return s.join(half, "binary").select("binary", "initial", "final", rate.alias("decay_rate"), "half_life")


def coverage(counts: DataFrame) -> DataFrame:
    """n, unique, total, theoretical_max, coverage, redundancy of n-gram counts; the space is a double, as V**4 is large."""
    c = counts.groupBy("n").agg(F.count("*").alias("unique"), F.sum("count").alias("total"))
    size = c.where("n = 1").select(F.col("unique").cast("double").alias("v"))
    rows = c.crossJoin(F.broadcast(size)).withColumn("theoretical_max", F.pow("v", "n"))
    return rows.select("n", "unique", "total", "theoretical_max", (F.col("unique") / F.col("theoretical_max")).alias("coverage"), (1 - F.col("unique") / F.col("total")).alias("redundancy"))


def nearest(points: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", block: int = 256) -> DataFrame:
    """q, neighbour, distance, r: the k nearest of all points to each query, exactly.

    Queries are worked through in blocks that are sent to all tasks; each task keeps
    its own k best of each query, so k rows a task and query are shuffled, not pairs.
    """
    import numpy as np
    import pyarrow as pa

    spark, out = points.sparkSession, None
    ids = [r[0] for r in queries.select(id_column).orderBy(id_column).collect()]
    for at in range(0, len(ids), block):
        part = queries.where(F.col(id_column).between(ids[at], ids[min(at + block, len(ids)) - 1])).select(id_column, vector).collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in part]), np.array([r[1] for r in part], float)))

        def run(batches, sent=sent):
            q_ids, q = sent.value
            best_d, best_i = np.full((len(q_ids), 0), 0.0), np.full((len(q_ids), 0), 0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                p_ids = batch.column(0).to_numpy(zero_copy_only=False)
                p = np.array(batch.column(1).to_pylist(), float)
                for a in range(0, len(p), 4096):
                    x = p[a : a + 4096]
                    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) if len(x) * len(q) < 20_000 else np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0))
                    i = np.broadcast_to(p_ids[a : a + 4096], d.shape)
                    d = np.where(i == q_ids[:, None], np.inf, d)
                    d, i = np.hstack([best_d, d]), np.hstack([best_i, i])
                    order = np.lexsort((i, d))[:, :k] if d.ndim == 2 else None
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            n = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["q", "neighbour", "distance"])

        rows = points.select(F.col(id_column).cast("long"), vector).mapInArrow(run, "q long, neighbour long, distance double")
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "q long, neighbour long, distance double, r int")
    r = F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbour"))
    return out.where("distance < double('inf')").withColumn("r", r).where(F.col("r") <= k)


def intrinsic_dimension(neighbours: DataFrame) -> DataFrame:
    """mean_dim, std_dim, valid: Levina and Bickel's maximum-likelihood estimate; zero distances are dropped."""
    d = neighbours.where("distance > 0")
    each = d.groupBy("q").agg(F.count("*").alias("m"), F.max("distance").alias("far"), F.sum(F.log("distance")).alias("logs"))
    spread = F.col("m") * F.log("far") - F.col("logs")
    each = each.where((F.col("m") >= 2) & (spread > 0)).select(((F.col("m") - 1) / spread).alias("dim"))
    return each.agg(F.avg("dim").alias("mean_dim"), F.stddev_pop("dim").alias("std_dim"), F.count("*").alias("valid"))
