"""Frequencies, power-law fits and n-gram entropies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy, ngrams
from ..sources.corpus import ends_with_following, token_rows


def opcode_frequency(functions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """[by], opcode, count: a partial and a final hash aggregate."""
    return token_rows(functions).groupBy(*by, "opcode").agg(F.count("*").alias("count"))


def ranked(counts: DataFrame, by: tuple[str, ...] = (), ties: str = "opcode") -> DataFrame:
    """Adds rank (by count, then by ties) and relative_frequency. Ranks over a whole vocabulary come from rank_all."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.desc("count"), ties)
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("relative_frequency", F.col("count") / F.sum("count").over(whole))


def rank_all(counts: DataFrame, ties: str = "opcode") -> DataFrame:
    """Adds rank and relative_frequency over all rows without one task seeing them all: ranks within a range partition, plus the rows of the ranges before."""
    dealt = counts.repartitionByRange(F.desc("count"), F.col(ties)).sortWithinPartitions(F.desc("count"), ties).withColumn("part", F.spark_partition_id())
    dealt = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("count"), ties)))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("count")).alias("c"), F.col(ties))).alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = counts.agg(F.sum("count").alias("total"))
    out = dealt.join(F.broadcast(sizes), "part").crossJoin(F.broadcast(total))  # one row
    return out.select(*counts.columns, (F.col("base") + F.col("r")).cast("long").alias("rank"), (F.col("count") / F.col("total")).alias("relative_frequency"))


def zipf_ols(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """[by], alpha, constant, r_squared of ln f = ln C - alpha ln r; zeros below two points."""
    x, y = F.log("rank"), F.log(F.col("count").cast("double"))
    few = F.count("*") < 2
    fit = lambda f: F.when(few, F.lit(0.0)).otherwise(F.coalesce(f, F.lit(0.0)))
    return ranks.groupBy(*by).agg(
        fit(-F.regr_slope(y, x)).alias("alpha"), fit(F.exp(F.regr_intercept(y, x))).alias("constant"),
        F.when(few | (F.coalesce(F.regr_syy(y, x), F.lit(0.0)) == 0), 0.0).otherwise(F.coalesce(F.regr_r2(y, x), F.lit(0.0))).alias("r_squared"),
    )


def zipf_log_likelihood(rank: np.ndarray, total: float, weighted: float, alpha: float) -> float:
    return -alpha * weighted - total * float(np.log(np.sum(rank**-alpha)))


def zipf_mle(vocabulary: int, total: float, weighted: float, low: float = 0.01, high: float = 15.0, steps: int = 200) -> float:
    """The exponent that makes the ranks most likely, from three sufficient statistics: golden-section search."""
    rank, g = np.arange(1, vocabulary + 1, dtype=float), (np.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = (zipf_log_likelihood(rank, total, weighted, x) for x in (c, d))
    for _ in range(steps):
        if b - a < 1e-10:
            break
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = zipf_log_likelihood(rank, total, weighted, c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = zipf_log_likelihood(rank, total, weighted, d)
    return (a + b) / 2


def zipf_bootstrap(vocabulary: int, total: int, alpha: float, rounds: int = 200, seed: int = 42) -> tuple[float, float]:
    """Parametric: multinomial draws from the fitted law, refitted; the 2.5 and 97.5 percentiles."""
    rng, rank = np.random.default_rng(seed), np.arange(1, vocabulary + 1, dtype=float)
    p = rank**-alpha
    p /= p.sum()
    fits = []
    for _ in range(rounds):
        counts = np.sort(rng.multinomial(total, p))[::-1]
        counts = counts[counts > 0]
        fits.append(zipf_mle(len(counts), float(total), float(counts @ np.log(rank[: len(counts)])), steps=40))
    return tuple(np.percentile(fits, [2.5, 97.5]))


def ols_bootstrap(rank: np.ndarray, count: np.ndarray, rounds: int = 200, seed: int = 42) -> tuple[float, float]:
    """Of the exponent of the line through resampled (rank, count) pairs; zeros below five points."""
    if len(rank) < 5:
        return 0.0, 0.0
    rng, x, y = np.random.default_rng(seed), np.log(rank), np.log(count)
    fits = []
    for _ in range(rounds):
        i = rng.integers(0, len(x), len(x))
        if np.ptp(x[i]) > 0:
            fits.append(-np.polyfit(x[i], y[i], 1)[0])
    return tuple(np.percentile(fits, [2.5, 97.5]))


def zipf_bootstrap_rounds(spark: SparkSession, vocabulary: int, total: int, alpha: float, rounds: int = 200, seed: int = 42) -> tuple[float, float]:
    """zipf_bootstrap with its rounds dealt out to tasks, each round with a seed of its own. A task holds the vocabulary's ranks."""

    def run(batches):
        rank = np.arange(1, vocabulary + 1, dtype=float)
        p, logs = rank**-alpha, np.log(rank)
        p /= p.sum()
        for batch in batches:
            fits = []
            for i in batch.column(0).to_pylist():
                counts = np.sort(np.random.default_rng([seed, i]).multinomial(total, p))[::-1]
                counts = counts[counts > 0]
                fits.append(zipf_mle(len(counts), float(total), float(counts @ logs[: len(counts)]), steps=40))
            yield pa.RecordBatch.from_arrays([pa.array(fits, pa.float64())], ["fit"])

    fits = [r.fit for r in spark.range(0, rounds, 1, min(rounds, 50)).mapInArrow(run, "fit double").collect()]
    return tuple(np.percentile(fits, [2.5, 97.5]))


def ols_bootstrap_rounds(ranks: DataFrame, rounds: int = 200, seed: int = 42) -> tuple[float, float, int]:
    """As ols_bootstrap over all rows of (rank, count), and their number: each row is drawn a Poisson number of times, and only sums of each round leave a task."""
    names = ["round", "w", "x", "y", "xx", "xy", "n"]

    def run(batches):
        sums, n = np.zeros((5, rounds)), 0
        for batch in batches:
            ranks, counts = (np.array(batch.column(i).to_pylist(), float) for i in (0, 1))
            block = ranks.astype(np.int64) // 4096
            for k in np.unique(block).tolist():
                r, c = ranks[block == k], counts[block == k]
                x, y = np.log(r), np.log(c)
                # seeded by block and taken by rank, so partitions and batches change nothing
                w = np.random.default_rng([seed, k]).poisson(1.0, (rounds, 4096))[:, r.astype(np.int64) % 4096]
                sums += np.array([w.sum(axis=1), w @ x, w @ y, w @ (x * x), w @ (x * y)])
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), *(pa.array(v) for v in sums), pa.array(np.full(rounds, n))], names)

    rows = ranks.select("rank", "count").mapInArrow(run, "round long, w double, x double, y double, xx double, xy double, n long")
    rows = rows.groupBy("round").agg(*(F.sum(c).alias(c) for c in names[1:])).orderBy("round").collect()
    if not rows or rows[0].n < 5:
        return 0.0, 0.0, rows[0].n if rows else 0
    w, x, y, xx, xy = (np.array([r[c] for r in rows]) for c in names[1:6])
    spread = w * xx - x * x
    fits = (-(w * xy - x * y) / np.where(spread > 0, spread, 1))[spread > 1e-9 * w * xx]
    return (*np.percentile(fits, [2.5, 97.5]), rows[0].n) if len(fits) else (0.0, 0.0, rows[0].n)


def ngram_starts(functions: DataFrame, most: int) -> DataFrame:
    """binary, o1..o_most: a row for each opcode, with those after it in the binary's whole sequence; null beyond its end.

    Rows that lie within a function are narrow; those that run on into the next ones
    come from the functions' ends, so no sequence is shuffled.
    """
    names = [f"o{i}" for i in range(1, most + 1)]

    def rows(line: str, n: Column) -> DataFrame:
        """Shifted copies of an array, side by side: the first n places."""
        shifted = F.arrays_zip(*(F.slice(line, i, F.greatest(n, F.lit(0))).alias(f"o{i}") for i in range(1, most + 1)))
        return F.inline(shifted)

    inner = functions.where(F.size("ops") >= most).select("binary", rows("ops", F.size("ops") - (most - 1)))
    if most == 1:
        return inner.toDF("binary", *names)
    ends = ends_with_following(functions, most - 1).select("binary", F.concat("tail", "following").alias("line"), F.size("tail").alias("own"))
    return inner.toDF("binary", *names).union(ends.select("binary", rows("line", F.col("own"))).toDF("binary", *names))


def _grams(functions: DataFrame, sizes: range | list[int], form) -> DataFrame:
    """binary, n and what form makes of the n columns of each n-gram."""
    starts = ngram_starts(functions, max(sizes))
    each = [F.when(F.col(f"o{n}").isNotNull(), F.struct(F.lit(n).alias("n"), *form([f"o{i}" for i in range(1, n + 1)]))) for n in sizes]
    return starts.select("binary", F.explode(F.array(*each)).alias("e")).where("e is not null").select("binary", "e.*")


def ngram_counts(functions: DataFrame, sizes: range | list[int], by: tuple[str, ...] = ("binary",)) -> DataFrame:
    """[by], n, ngram, count over the binaries' whole sequences: n-grams run on across functions. All n in one pass."""
    grams = _grams(functions, sizes, lambda c: [F.concat_ws(" ", *c).alias("ngram")])
    return grams.groupBy(*by, "n", "ngram").agg(F.count("*").alias("count"))


def ngram_frequencies(functions: DataFrame, sizes: range | list[int], by: tuple[str, ...] = ("binary",)) -> DataFrame:
    """[by], n, count: as ngram_counts, without the n-grams. They are told apart by 128 bits, so no strings are moved."""
    grams = _grams(functions, sizes, lambda c: [F.xxhash64(*c).alias("h1"), F.xxhash64(F.lit(len(c)), *reversed(c)).alias("h2")])
    return grams.groupBy(*by, "n", "h1", "h2").agg(F.count("*").alias("count"))


def entropy_rates(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """[by], n, entropy, entropy_rate, conditional_entropy, unique_ngrams, total_ngrams, max_entropy (of the opcodes), normalized_entropy. counts has a row for each n-gram, or for so many as times says."""
    times = F.col("times") if "times" in counts.columns else F.lit(1).cast("long")
    total = F.sum(F.col("count") * times)
    h = counts.groupBy(*by, "n").agg(entropy("count", times).alias("entropy"), F.sum(times).alias("unique_ngrams"), total.alias("total_ngrams"))
    order = Window.partitionBy(*by).orderBy("n")  # five rows a group
    h = h.withColumn("conditional_entropy", F.col("entropy") - F.lag("entropy", 1, 0.0).over(order))
    first = F.first(F.when(F.col("n") == 1, F.col("unique_ngrams")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    h = h.withColumn("max_entropy", F.log2(first.cast("double")))
    return h.select(
        *by, "n", "entropy", (F.col("entropy") / F.col("n")).alias("entropy_rate"), "conditional_entropy", "unique_ngrams", "total_ngrams", "max_entropy",
        F.when(F.col("max_entropy") > 0, F.col("entropy") / F.col("max_entropy")).otherwise(0.0).alias("normalized_entropy"),
    )


def shuffle_key(seed: str, *columns: str) -> Column:
    """A fixed order that looks random: the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def shuffled(positions: DataFrame, seed: str = "42", cells: int = 1) -> DataFrame:
    """The opcodes of each binary in a fixed random order: binary, pos, opcode."""
    order = Window.partitionBy("binary").orderBy(shuffle_key(seed, "binary", "pos"), "pos")
    return positions.select("binary", "category", (F.row_number().over(order) - 1).cast("long").alias("pos"), "opcode")


def as_functions(positions: DataFrame, block: int = 1024) -> DataFrame:
    """Positions as functions of block opcodes: bounded arrays from any order."""
    rows = positions.groupBy("binary", F.floor(F.col("pos") / block).alias("func")).agg(F.max("category").alias("category"), F.array_sort(F.collect_list(F.struct("pos", "opcode"))).alias("e"))
    return rows.select("binary", "category", "func", F.col("e.opcode").alias("ops"))
