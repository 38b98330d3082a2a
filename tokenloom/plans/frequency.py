"""Queries: frequencies, fits, n-gram entropies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, r6
from ..operators import frequency as op
from ..operators.ngram_blocks import spectrum
from ..sources.corpus import document_functions, event_functions, positions, vocabulary
from .registry import query

RANKED = """WITH {TOK}, c AS (SELECT opcode, count(*) AS n FROM tok GROUP BY 1),
 r AS (SELECT opcode, n, row_number() OVER (ORDER BY n DESC, opcode) AS rank, n / sum(n) OVER () AS f FROM c) """


@query("d01_opcode_frequency", RANKED + "SELECT opcode, n AS count, rank, round(f, 6) AS relative_frequency FROM r")
def d01(spark, d):
    return op.rank_all(op.opcode_frequency(document_functions(spark, d))).withColumn("relative_frequency", r6(F.col("relative_frequency")))


@query("d02_opcode_frequency_per_binary", """WITH {TOK}, c AS (SELECT binary, opcode, count(*) AS n FROM tok GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY binary ORDER BY n DESC, opcode) AS rank, n / sum(n) OVER (PARTITION BY binary) AS f FROM c)
 SELECT binary, opcode, n AS count, rank, round(f, 6) AS relative_frequency FROM r WHERE rank <= 10""")
def d02(spark, d):
    top = op.ranked(op.opcode_frequency(document_functions(spark, d), ("binary",)), ("binary",)).where("rank <= 10")
    return top.withColumn("relative_frequency", r6(F.col("relative_frequency")))


@query("e01_zipf_ols", RANKED + "SELECT round(-regr_slope(ln(n), ln(rank)), 6) AS alpha, round(exp(regr_intercept(ln(n), ln(rank))), 3) AS constant, round(regr_r2(ln(n), ln(rank)), 6) AS r_squared FROM r")
def e01(spark, d):
    fit = op.zipf_ols(op.rank_all(op.opcode_frequency(document_functions(spark, d))))
    return fit.select(r6(F.col("alpha")).alias("alpha"), F.round("constant", 3).alias("constant"), r6(F.col("r_squared")).alias("r_squared"))


@query("e01_zipf_ols_per_binary", """WITH {TOK}, c AS (SELECT binary, opcode, count(*) AS n FROM tok GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY binary ORDER BY n DESC, opcode) AS rank FROM c)
 SELECT binary, count(*) AS unique_opcodes, round(-regr_slope(ln(n), ln(rank)), 6) AS alpha, round(regr_r2(ln(n), ln(rank)), 6) AS r_squared FROM r GROUP BY 1 HAVING count(*) > 2""")
def e01b(spark, d):
    ranks = op.ranked(op.opcode_frequency(document_functions(spark, d), ("binary",)), ("binary",))
    fit = op.zipf_ols(ranks, ("binary",)).join(ranks.groupBy("binary").agg(F.count("*").alias("unique_opcodes")), "binary").where("unique_opcodes > 2")
    return fit.select("binary", "unique_opcodes", r6(F.col("alpha")).alias("alpha"), r6(F.col("r_squared")).alias("r_squared"))


@query("e04_zipf_ks_lognormal", RANKED + """, z AS (SELECT rank, n, power(rank, -1.2) / sum(power(rank, -1.2)) OVER () AS p, n / sum(n) OVER () AS q FROM r),
 k AS (SELECT max(abs(cp - cq)) AS ks FROM (SELECT sum(p) OVER (ORDER BY rank) AS cp, sum(q) OVER (ORDER BY rank) AS cq FROM z)),
 m AS (SELECT avg(ln(n)) AS mu, stddev_pop(ln(n)) AS sigma FROM z)
 SELECT 1.2 AS alpha, round((SELECT ks FROM k), 6) AS ks_stat, round(sum(n * ln(p)), 2) AS ll_zipf,
        round(sum(-ln(n) - ln(sigma) - 0.5 * ln(2 * pi()) - power(ln(n) - mu, 2) / (2 * sigma * sigma)), 2) AS ll_lognormal
 FROM z, m""")
def e04(spark, d, alpha: float = 1.2):
    """Kolmogorov-Smirnov distance to the law with a given exponent, and the likelihood of a log-normal alternative. The vocabulary's ranks run in range partitions; only prefix sums of ranges meet."""
    z = op.rank_all(op.opcode_frequency(document_functions(spark, d))).withColumn("w", F.pow("rank", F.lit(-alpha)))
    y = F.log(F.col("count").cast("double"))
    total = z.agg(F.sum("w").alias("tw"), F.sum("count").alias("tn"), F.avg(y).alias("mu"), F.stddev_pop(y).alias("sigma"))
    part = z.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("rank")
    part = part.withColumn("cw", F.sum("w").over(inside)).withColumn("cn", F.sum("count").over(inside))
    ends = part.groupBy("part").agg(F.max("cw").alias("ew"), F.max("cn").alias("en"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.coalesce(F.sum("ew").over(before), F.lit(0.0)).alias("bw"), F.coalesce(F.sum("en").over(before), F.lit(0)).alias("bn"))
    rows = part.join(F.broadcast(ends), "part").crossJoin(F.broadcast(total))
    ks = F.max(F.abs((F.col("cw") + F.col("bw")) / F.col("tw") - (F.col("cn") + F.col("bn")) / F.col("tn")))
    ll = F.sum(F.col("count") * F.log(F.col("w") / F.col("tw")))
    log_normal = F.sum(-y - F.log("sigma") - 0.5 * np.log(2 * np.pi) - F.pow(y - F.col("mu"), F.lit(2)) / (2 * F.col("sigma") * F.col("sigma")))
    return rows.agg(r6(ks).alias("ks_stat"), F.round(ll, 2).alias("ll_zipf"), F.round(log_normal, 2).alias("ll_lognormal")).select(F.lit(alpha).alias("alpha"), "*")


@query("e03_zipf_mle")
def e03(spark, d):
    """MLE exponent with its bootstrap interval: draws of all occurrences over all ranks, in rounds dealt out to tasks."""
    ranks = op.rank_all(op.opcode_frequency(document_functions(spark, d)))
    n, total, weighted = ranks.agg(F.count("*"), F.sum("count"), F.sum(F.col("count") * F.log("rank"))).first()
    if not n:
        return spark.createDataFrame([], "alpha double, ci_low double, ci_high double, vocabulary long, total long")
    alpha = op.zipf_mle(n, float(total), weighted)
    low, high = op.zipf_bootstrap_rounds(spark, n, int(total), alpha)
    return spark.createDataFrame([(float(alpha), float(low), float(high), n, int(total))], "alpha double, ci_low double, ci_high double, vocabulary long, total long")


@query("b03_vocabulary", "WITH {TOK} SELECT opcode, row_number() OVER (ORDER BY opcode) - 1 AS id FROM (SELECT DISTINCT opcode FROM tok)")
def b03(spark, d):
    from ..sources.corpus import token_rows

    return vocabulary(token_rows(document_functions(spark, d)))


@query("b04_encode", """WITH {TOK}, v AS (SELECT opcode, row_number() OVER (ORDER BY opcode) - 1 AS id FROM (SELECT DISTINCT opcode FROM tok WHERE category = 'en'))
 SELECT binary, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(coalesce(id, (SELECT count(*) FROM v))) AS BIGINT) AS id_sum, CAST(count(*) FILTER (id IS NULL) AS BIGINT) AS unknown FROM tok LEFT JOIN v USING (opcode) GROUP BY 1""")
def b04(spark, d):
    """Encode all binaries with the English vocabulary; unknown opcodes get its size."""
    from ..sources.corpus import token_rows

    tokens = token_rows(document_functions(spark, d))
    words = vocabulary(tokens.where("category = 'en'"))
    size = F.broadcast(words.agg(F.count("*").alias("size")))
    rows = tokens.groupBy("binary", "opcode").agg(F.count("*").alias("n")).join(words, "opcode", "left").crossJoin(size)
    return rows.groupBy("binary").agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.coalesce("id", "size")).alias("id_sum"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))


GRAMS = """WITH {TOK}, w AS (SELECT binary, pos, opcode, lead(opcode) OVER o AS o2, lead(opcode, 2) OVER o AS o3, lead(opcode, 3) OVER o AS o4, lead(opcode, 4) OVER o AS o5 FROM pos WINDOW o AS (PARTITION BY binary ORDER BY pos)),
 g AS (SELECT binary, 1 AS n, opcode AS ngram FROM w UNION ALL SELECT binary, 2, opcode || ' ' || o2 FROM w WHERE o2 IS NOT NULL
   UNION ALL SELECT binary, 3, opcode || ' ' || o2 || ' ' || o3 FROM w WHERE o3 IS NOT NULL UNION ALL SELECT binary, 4, opcode || ' ' || o2 || ' ' || o3 || ' ' || o4 FROM w WHERE o4 IS NOT NULL
   UNION ALL SELECT binary, 5, opcode || ' ' || o2 || ' ' || o3 || ' ' || o4 || ' ' || o5 FROM w WHERE o5 IS NOT NULL) """

RATES = """SELECT {by} n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, count(*) AS u, sum(c) AS t FROM c GROUP BY {by} n"""


@query("d03_ngram_top50", GRAMS + """, c AS (SELECT n, ngram, count(*) AS c FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, ngram) AS rn, c / sum(c) OVER (PARTITION BY n) AS f FROM c)
 SELECT n, ngram, c AS count, round(f, 6) AS frequency, rn FROM r WHERE rn <= 50 AND n >= 2""")
def d03(spark, d):
    counts = op.ngram_counts(document_functions(spark, d), [2, 3, 4, 5], ())
    total = F.broadcast(counts.groupBy("n").agg(F.sum("count").alias("total")))  # a row for each n
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "ngram")).cast("long")).where("rn <= 50")
    return top.join(total, "n").select("n", "ngram", "count", r6(F.col("count") / F.col("total")).alias("frequency"), "rn")


RATE_COLUMNS = """n, round(h, 6) AS entropy, round(h / n, 6) AS entropy_rate, round(h - coalesce(lag(h) OVER (PARTITION BY {p} ORDER BY n), 0), 6) AS conditional_entropy, u AS unique_ngrams,
 CAST(t AS BIGINT) AS total_ngrams, round(log2(first_value(u) OVER (PARTITION BY {p} ORDER BY n)), 6) AS max_entropy, round(h / nullif(log2(first_value(u) OVER (PARTITION BY {p} ORDER BY n)), 0), 6) AS normalized_entropy"""


def _rounded(df, by=()):
    floats = [c for c, k in df.dtypes if k == "double"]
    return df.select(*(r6(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


@query("d07_entropy_rate", GRAMS + ", c AS (SELECT n, ngram, count(*) AS c FROM g GROUP BY 1, 2), e AS (" + RATES.replace("{by}", "") + ") SELECT " + RATE_COLUMNS.replace("{p}", "1") + " FROM e")
def d07(spark, d):
    return _rounded(op.entropy_rates(op.ngram_frequencies(document_functions(spark, d), range(1, 6), ())))


@query("d09_entropy_rate_per_binary", GRAMS + ", c AS (SELECT binary, n, ngram, count(*) AS c FROM g GROUP BY 1, 2, 3), e AS (" + RATES.replace("{by}", "binary,") + ") SELECT binary, " + RATE_COLUMNS.replace("{p}", "binary") + " FROM e WHERE binary IN (SELECT binary FROM e WHERE n = 1 AND u > 1)")
def d09(spark, d):
    rates = op.entropy_rates(spectrum(document_functions(spark, d), 5), ("binary",))
    return _rounded(rates.where("max_entropy > 0"))


SHUFFLED = """WITH {EVT}, s AS (SELECT binary, category, row_number() OVER (PARTITION BY binary ORDER BY md5('42|' || binary || '|' || CAST(pos AS VARCHAR)), pos) - 1 AS pos, opcode FROM pos),"""
EVENT_GRAMS = """ (SELECT binary, 1 AS n, opcode AS ngram FROM {t} UNION ALL SELECT binary, 2, opcode || ' ' || o2 FROM (SELECT *, lead(opcode) OVER (PARTITION BY binary ORDER BY pos) AS o2 FROM {t}) WHERE o2 IS NOT NULL
   UNION ALL SELECT binary, 3, opcode || ' ' || o2 || ' ' || o3 FROM (SELECT *, lead(opcode) OVER (PARTITION BY binary ORDER BY pos) AS o2, lead(opcode, 2) OVER (PARTITION BY binary ORDER BY pos) AS o3 FROM {t}) WHERE o3 IS NOT NULL)"""


@query("d10_shuffled_entropy_gain", SHUFFLED + " a AS" + EVENT_GRAMS.replace("{t}", "pos") + ", b AS" + EVENT_GRAMS.replace("{t}", "s")
    + """, x AS (SELECT n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT n, ngram, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY n),
 y AS (SELECT n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT n, ngram, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY n)
 SELECT n, round(x.h, 6) AS real_entropy, round(y.h, 6) AS shuffled_entropy, round(x.h - y.h, 6) AS entropy_gain FROM x JOIN y USING (n)""")  # fmt: skip
def d10(spark, d):
    functions = event_functions(spark, d)
    mixed = op.as_functions(op.shuffled(positions(functions)))
    rates = lambda f, name: op.entropy_rates(op.ngram_frequencies(f, range(1, 4), ())).select("n", F.col("entropy").alias(name))
    return _rounded(rates(functions, "real_entropy").join(rates(mixed, "shuffled_entropy"), "n").withColumn("entropy_gain", F.col("real_entropy") - F.col("shuffled_entropy")))


@query("d05_conditional_entropy", GRAMS + """, b AS (SELECT split_part(ngram, ' ', 1) AS x, count(*) AS c FROM g WHERE n = 2 GROUP BY ngram), k AS (SELECT x, sum(c) AS t, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM b GROUP BY x)
 SELECT round(sum(t * h) / sum(t), 6) AS conditional_entropy FROM k""")
def d05(spark, d):
    from ..functions.scalars import entropy

    pairs = op.ngram_counts(document_functions(spark, d), [2], ()).withColumn("x", F.substring_index("ngram", " ", 1))
    each = pairs.groupBy("x").agg(F.sum("count").alias("t"), entropy().alias("h"))
    return each.agg(r6(F.sum(F.col("t") * F.col("h")) / F.sum("t")).alias("conditional_entropy"))


@query("d11_predictability", GRAMS + ", c AS (SELECT n, ngram, count(*) AS c FROM g GROUP BY 1, 2), e AS (" + RATES.replace("{by}", "") + """), m AS (SELECT log2(u) AS x FROM e WHERE n = 1),
 s AS (SELECT max(CASE WHEN n = 5 THEN h / n END) AS r5, max(CASE WHEN n = 2 THEN h / n END) AS r2, arg_min(n, h / n) FILTER (n >= 2) AS best_n FROM e)
 SELECT round(r5, 6) AS final_rate, round(r5 / x, 6) AS predictability_ratio, CASE WHEN r5 / x < 0.1 THEN 'Highly predictable' WHEN r5 / x < 0.3 THEN 'Predictable' WHEN r5 / x < 0.6 THEN 'Moderate' WHEN r5 / x < 0.8 THEN 'Weak' ELSE 'Random-like' END AS label,
        best_n, round((r2 - r5) / r2, 6) AS decay_rate FROM s, m""")
def d11(spark, d):
    e = op.entropy_rates(op.ngram_frequencies(document_functions(spark, d), range(1, 6), ()))
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("entropy_rate")))
    s = e.agg(at(5).alias("r5"), at(2).alias("r2"), F.max("max_entropy").alias("x"), F.min_by("n", F.when(F.col("n") >= 2, F.col("entropy_rate"))).alias("best_n"))
    ratio = F.col("r5") / F.col("x")
    label = ladder(ratio, [(0.1, "Highly predictable"), (0.3, "Predictable"), (0.6, "Moderate"), (0.8, "Weak")], "Random-like", above=False)
    return s.select(r6(F.col("r5")).alias("final_rate"), r6(ratio).alias("predictability_ratio"), label.alias("label"), "best_n", r6((F.col("r2") - F.col("r5")) / F.col("r2")).alias("decay_rate"))


@query("d12_corpus_summary", """WITH {TOK}, b AS (SELECT binary, any_value(category) AS category, count(*) AS n, count(DISTINCT func) AS f FROM tok GROUP BY 1)
 SELECT count(*) AS num_binaries, (SELECT count(DISTINCT opcode) FROM tok) AS vocab_size, CAST(sum(n) AS BIGINT) AS total_instructions, CAST(sum(f) AS BIGINT) AS total_functions,
        min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS mean_len, (SELECT string_agg(category, ',' ORDER BY category) FROM (SELECT DISTINCT category FROM b)) AS categories FROM b""")
def d12(spark, d):
    functions = document_functions(spark, d)
    b = functions.groupBy("binary").agg(F.max("category").alias("category"), F.sum(F.size("ops")).alias("n"), F.count("*").alias("f"))
    words = op.opcode_frequency(functions).agg(F.count("*").alias("vocab_size"))
    s = b.agg(F.count("*").alias("num_binaries"), F.sum("n").alias("total_instructions"), F.sum("f").alias("total_functions"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), r6(F.avg("n")).alias("mean_len"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    return s.crossJoin(words)


@query("d34_corpus_patterns", GRAMS + """, c AS (SELECT n, ngram, count(*) AS c FROM g WHERE n <= 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, ngram) AS rn FROM c)
 SELECT n, ngram, c AS count, rn, (SELECT CAST(sum(c) AS BIGINT) FROM c WHERE n = 1) AS total_instructions, round((SELECT count(*) / sum(c) FROM c WHERE n = 1), 6) AS diversity_ratio FROM r WHERE rn <= 10""")
def d34(spark, d):
    c = op.ngram_counts(document_functions(spark, d), [1, 2], ())
    one = c.where("n = 1").agg(F.sum("count").alias("total_instructions"), r6(F.count("*") / F.sum("count")).alias("diversity_ratio"))
    top = c.withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "ngram")).cast("long")).where("rn <= 10")
    return top.crossJoin(F.broadcast(one))


@query("n03_universal_patterns", """WITH {TOK} SELECT opcode, count(DISTINCT binary) AS binaries FROM tok GROUP BY 1 HAVING count(DISTINCT binary) > 0.8 * (SELECT count(DISTINCT binary) FROM tok)""")
def n03(spark, d):
    """Opcodes in more than four fifths of all binaries."""
    each = op.opcode_frequency(document_functions(spark, d), ("binary",))
    return each.groupBy("opcode").agg(F.count("*").alias("binaries")).crossJoin(F.broadcast(each.agg(F.countDistinct("binary").alias("all")))).where(F.col("binaries") > 0.8 * F.col("all")).drop("all")


@query("n04_temporal_evolution", """WITH p AS (SELECT event_type AS opcode, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT day, sum(n) AS total FROM p GROUP BY 1),
 s AS (SELECT opcode, arg_min(n / total, p.day) AS first, arg_max(n / total, p.day) AS last FROM p JOIN t ON p.day = t.day GROUP BY 1)
 SELECT opcode, round(first, 6) AS first_share, round(last, 6) AS last_share, CASE WHEN last > 1.2 * first THEN 'increasing' WHEN last < 0.8 * first THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def n04(spark, d):
    from ..sources.corpus import table

    p = table(spark, d, "events").groupBy(F.col("event_type").alias("opcode"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    p = p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("day")))
    s = p.groupBy("opcode").agg(F.min_by("share", "day").alias("a"), F.max_by("share", "day").alias("z"))
    trend = F.when(F.col("z") > 1.2 * F.col("a"), "increasing").when(F.col("z") < 0.8 * F.col("a"), "decreasing").otherwise("stable")
    return s.select("opcode", r6(F.col("a")).alias("first_share"), r6(F.col("z")).alias("last_share"), trend.alias("trend"))
