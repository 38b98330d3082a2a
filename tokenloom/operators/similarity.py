"""Pairwise similarity, separation tests and clustering scores over long relations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_FEATURES = 10_000


def term_frequencies(counts: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """binary, ngram, tf: shares over the top n-grams of the corpus. counts: binary, ngram, count of one n."""
    best = counts.groupBy("ngram").agg(F.sum("count").alias("all")).orderBy(F.desc("all"), "ngram").limit(top).select("ngram")
    rows = counts.join(F.broadcast(best), "ngram")  # top rows at most
    return rows.withColumn("tf", F.col("count") / F.sum("count").over(Window.partitionBy("binary"))).select("binary", "ngram", "tf")


def cosine(tf: DataFrame) -> DataFrame:
    """a, b, similarity, distance of all pairs a < b, by the n-grams that they share: an equi-join, no cross join. Pairs that share nothing have no row."""
    norms = tf.groupBy("binary").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    unit = tf.join(norms, "binary").select("binary", "ngram", (F.col("tf") / F.col("norm")).alias("x"))
    a, b = unit.toDF("a", "ngram", "xa"), unit.toDF("b", "ngram", "xb")
    pairs = a.join(b, "ngram").where("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("similarity"))
    return pairs.withColumn("distance", 1 - F.col("similarity"))


def all_pairs(binaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds the pairs that share nothing, at similarity 0. The reference's matrix is dense; binaries are few."""
    every = binaries.select(F.col("binary").alias("a")).join(binaries.select(F.col("binary").alias("b")), F.col("a") < F.col("b"))
    return every.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("distance", F.lit(1.0)).alias("distance"))


def matrix_stats(pairs: DataFrame, column: str = "distance") -> DataFrame:
    c = F.col(column)
    return pairs.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.percentile(c, F.lit(0.5)).alias("median"), F.count("*").alias("pairs"))


def mann_whitney(pairs: DataFrame, value: str = "distance", group: str = "within") -> DataFrame:
    """n_within, n_between, means, u, effect_r (1 - 2u/n1n2) and the normal p-value, one-sided: within smaller. Ranks of ties are averaged, from counts by value."""
    by = pairs.groupBy(F.col(value).alias("v")).agg(F.sum(F.col(group).cast("long")).alias("n1"), F.count("*").alias("n"))
    part = by.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id())
    part = part.withColumn("inside", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    ends = part.groupBy("part").agg(F.max("inside").alias("end"))
    ends = ends.select("part", F.coalesce(F.sum("end").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("inside") - F.col("n") + (F.col("n") + 1) / 2
    rows = part.join(F.broadcast(ends), "part")
    s = rows.agg(F.sum("n1").alias("n_within"), F.sum(F.col("n") - F.col("n1")).alias("n_between"), F.sum(F.col("n1") * rank).alias("r1"), F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"),
                 F.sum(F.col("n1") * F.col("v")).alias("s1"), F.sum((F.col("n") - F.col("n1")) * F.col("v")).alias("s2"))
    u = F.col("r1") - F.col("n_within") * (F.col("n_within") + 1) / 2
    s = s.withColumn("u", u).withColumn("nn", (F.col("n_within") * F.col("n_between")).cast("double")).withColumn("t", (F.col("n_within") + F.col("n_between")).cast("double"))
    sd = F.sqrt(F.col("nn") / 12 * (F.col("t") + 1 - F.col("ties") / (F.col("t") * (F.col("t") - 1))))
    return s.select("n_within", "n_between", (F.col("s1") / F.col("n_within")).alias("mean_within"), (F.col("s2") / F.col("n_between")).alias("mean_between"), "u", (1 - 2 * F.col("u") / F.col("nn")).alias("effect_r"), ((F.col("u") - F.col("nn") / 2 + 0.5) / sd).alias("z"))


def p_less(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def permutation_test(spark, names: list[str], labels: list[str], matrix: np.ndarray, rounds: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """mean(between) - mean(within) and its p-value over label permutations, spread over tasks: the matrix of a few binaries is sent to all."""
    import pyarrow as pa

    i, j = np.triu_indices(len(names), 1)
    values, codes = matrix[i, j], np.unique(labels, return_inverse=True)[1]

    def stat(c: np.ndarray) -> float:
        same = c[i] == c[j]
        return float(values[~same].mean() - values[same].mean()) if same.any() and not same.all() else 0.0

    observed = stat(codes)

    def run(batches):
        for batch in batches:
            hits = [stat(np.random.default_rng([seed, k]).permutation(codes)) >= observed for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(hits)], pa.int64())], ["ge"])

    ge = spark.range(rounds).mapInArrow(run, "ge long").agg(F.sum("ge")).first()[0] or 0
    return observed, (ge + 1) / (rounds + 1)


def silhouette(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean silhouette of labelled items under a distance of pairs (both directions are made here). labels: item, label; pairs: a, b, distance."""
    both = pairs.select("a", "b", "distance").union(pairs.select("b", "a", "distance"))
    named = both.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    mean = named.groupBy("a", "la", "lb").agg(F.avg("distance").alias("m"))
    each = mean.groupBy("a", "la").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("inside"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("outside"))
    s = F.when(F.col("inside").isNull(), 0.0).otherwise((F.col("outside") - F.col("inside")) / F.greatest("inside", "outside"))
    return each.where("outside is not null").agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def purity(labels: DataFrame) -> DataFrame:
    """cluster, size, majority, purity of (cluster, category) rows."""
    c = labels.groupBy("cluster", F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    return c.groupBy("cluster").agg(F.sum("n").alias("size"), F.max_by("category", F.struct("n", "category")).alias("majority"), (F.max("n") / F.sum("n")).alias("purity"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """ari of two labellings x and y of the same items, from their contingency table."""
    pairs = lambda c: c * (c - 1) / 2
    t = labels.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    index = t.agg(F.sum(pairs(F.col("n"))).alias("index"), pairs(F.sum("n")).alias("all"))
    side = lambda c: t.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"pairs_{c}"))
    s = index.crossJoin(side("x")).crossJoin(side("y"))
    expected, most = F.col("pairs_x") * F.col("pairs_y") / F.col("all"), (F.col("pairs_x") + F.col("pairs_y")) / 2
    return s.select(F.when(most == expected, 1.0).otherwise((F.col("index") - expected) / (most - expected)).alias("ari"))


def tfidf(shingled: DataFrame) -> DataFrame:
    """doc, shingle, tfidf: 1 + ln tf, smooth idf, unit length. shingled: doc, shingle, tf."""
    n = shingled.agg(F.countDistinct("doc").alias("docs"))
    df = shingled.groupBy("shingle").agg(F.count("*").alias("df"))
    rows = shingled.join(df, "shingle").crossJoin(F.broadcast(n))
    rows = rows.withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    return rows.withColumn("tfidf", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))).select("doc", "shingle", "tfidf")
