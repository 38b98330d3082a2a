"""Queries: sliding entropy, mutual information, coverage, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ladder, r6
from ..operators import information as op
from ..operators.frequency import as_functions, ngram_counts, shuffled
from ..sources.corpus import document_functions, event_functions, positions, table
from .frequency import GRAMS, SHUFFLED
from .registry import query

SLIDE = """WITH {EVT}, z AS (SELECT binary, max(pos) + 1 AS n FROM pos GROUP BY 1), s AS (SELECT z.binary, unnest(range(0, n - 15, 4)) AS start FROM z WHERE n >= 16),
 c AS (SELECT s.binary, s.start, opcode, count(*) AS c FROM s JOIN pos ON pos.binary = s.binary AND pos.pos >= s.start AND pos.pos < s.start + 16 GROUP BY 1, 2, 3),
 e AS (SELECT binary, start, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY 1, 2) """


@query("g01_sliding_entropy", SLIDE + "SELECT binary, start, start + 8 AS middle, round(h, 6) AS entropy FROM e")
def g01(spark, d):
    return op.sliding_entropy(positions(event_functions(spark, d)), 16).withColumn("entropy", r6(F.col("entropy")))


@query("d31_sliding_entropy_stats", SLIDE + "SELECT binary, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, round(min(h), 6) AS min, round(max(h), 6) AS max, count(*) AS n FROM e GROUP BY 1")
def d31(spark, d):
    e = op.sliding_entropy(positions(event_functions(spark, d)), 16)
    return e.groupBy("binary").agg(*(r6(f("entropy")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))), F.count("*").alias("n"))


@query("b09_trace_downsample", """WITH {TOK}, z AS (SELECT binary, count(*) AS n FROM pos GROUP BY 1), p AS (SELECT binary, pos AS start, opcode, n FROM pos JOIN z USING (binary))
 SELECT binary, start, opcode FROM p WHERE n <= 500 OR start % floor(n / 500) = 0""")
def b09(spark, d):
    return op.thin(positions(document_functions(spark, d)).select("binary", F.col("pos").alias("start"), "opcode"))


def _mi_sql(source: str, lags: int, k: str = "") -> str:
    return f"""p{k} AS (SELECT * FROM {source} WHERE pos < 50000), z{k} AS (SELECT binary, count(*) AS n FROM p{k} GROUP BY 1), l{k} AS (SELECT binary, unnest(range(1, least({lags}, n // 2) + 1)) AS lag FROM z{k} WHERE n >= 10),
     j{k} AS (SELECT a.binary, l.lag, a.opcode AS x, b.opcode AS y, count(*) AS c FROM l{k} l JOIN p{k} a ON a.binary = l.binary JOIN p{k} b ON b.binary = a.binary AND b.pos = a.pos + l.lag GROUP BY 1, 2, 3, 4),
     w{k} AS (SELECT *, sum(c) OVER (PARTITION BY binary, lag) AS n, sum(c) OVER (PARTITION BY binary, lag, x) AS cx, sum(c) OVER (PARTITION BY binary, lag, y) AS cy FROM j{k}),
     mi{k} AS (SELECT binary, lag, sum(c / n * log2(c * n / (cx * cy))) AS mi FROM w{k} GROUP BY 1, 2) """


@query("d26_mutual_information", "WITH {EVT}, " + _mi_sql("pos", 50) + "SELECT binary, lag, round(mi, 6) AS mi FROM mi")
def d26(spark, d):
    return op.mutual_information(event_functions(spark, d), 50).select("binary", "lag", r6(F.col("mi")).alias("mi"))


@query("d26_mutual_information_documents", "WITH {TOK}, " + _mi_sql("pos", 3) + "SELECT binary, lag, round(mi, 6) AS mi FROM mi")
def d26b(spark, d):
    return op.mutual_information(document_functions(spark, d), 3).select("binary", "lag", r6(F.col("mi")).alias("mi"))


@query("d27_mi_gain", SHUFFLED + " " + _mi_sql("pos", 10) + ", " + _mi_sql("s", 10, "2") + """ SELECT lag, round(avg(mi.mi), 6) AS mi, round(avg(mi2.mi), 6) AS shuffled_mi, round(avg(mi.mi - mi2.mi), 6) AS gain FROM mi JOIN mi2 USING (binary, lag) GROUP BY 1""")
def d27(spark, d):
    functions = event_functions(spark, d)
    real = op.mutual_information(functions, 10)
    mixed = op.mutual_information(as_functions(shuffled(positions(functions))), 10).withColumnRenamed("mi", "m2")
    return real.join(mixed, ["binary", "lag"]).groupBy("lag").agg(r6(F.avg("mi")).alias("mi"), r6(F.avg("m2")).alias("shuffled_mi"), r6(F.avg(F.col("mi") - F.col("m2"))).alias("gain"))


@query("d28_mi_decay", "WITH {EVT}, " + _mi_sql("pos", 50) + """, s AS (SELECT binary, arg_min(mi, lag) AS i, arg_max(mi, lag) AS f FROM mi GROUP BY 1)
 SELECT s.binary, round(i, 6) AS initial, round(f, 6) AS final, round(CASE WHEN i > 0 THEN (i - f) / i ELSE 0 END, 6) AS decay_rate, (SELECT min(lag) FROM mi WHERE mi.binary = s.binary AND mi.mi <= s.i / 2) AS half_life FROM s""")
def d28(spark, d):
    return op.decay(op.mutual_information(event_functions(spark, d), 50)).select("binary", r6(F.col("initial")).alias("initial"), r6(F.col("final")).alias("final"), r6(F.col("decay_rate")).alias("decay_rate"), "half_life")


@query("d29_corpus_mean_mi", "WITH {EVT}, " + _mi_sql("pos", 50) + "SELECT lag, round(avg(mi), 6) AS mean_mi, count(*) AS binaries FROM mi GROUP BY 1")
def d29(spark, d):
    return op.mutual_information(event_functions(spark, d), 50).groupBy("lag").agg(r6(F.avg("mi")).alias("mean_mi"), F.count("*").alias("binaries"))


@query("d30_space_coverage", GRAMS + """, c AS (SELECT n, ngram, count(*) AS c FROM g WHERE n <= 4 GROUP BY 1, 2), s AS (SELECT n, count(*) AS u, sum(c) AS t FROM c GROUP BY 1), v AS (SELECT CAST(u AS DOUBLE) AS v FROM s WHERE n = 1)
 SELECT n, u AS unique, CAST(t AS BIGINT) AS total, power(v, n) AS theoretical_max, round(u / power(v, n), 12) AS coverage, round(1 - u / t, 6) AS redundancy, CASE WHEN u / power(v, n) > 0.5 THEN 'Dense' WHEN u / power(v, n) > 0.1 THEN 'Moderate' WHEN u / power(v, n) > 0.01 THEN 'Sparse' ELSE 'Very sparse' END AS label FROM s, v""")
def d30(spark, d):
    c = op.coverage(ngram_counts(document_functions(spark, d), [1, 2, 3, 4], ()))
    label = ladder(F.col("coverage"), [(0.5, "Dense"), (0.1, "Moderate"), (0.01, "Sparse")], "Very sparse")
    return c.select("n", "unique", "total", "theoretical_max", F.round("coverage", 12).alias("coverage"), r6(F.col("redundancy")).alias("redundancy"), label.alias("label"))


KNN = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS q, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, neighbour) AS r FROM d QUALIFY r <= 5) """


@query("c14_knn", KNN + "SELECT q, neighbour, round(distance, 4) AS distance, r FROM k")
def c14(spark, d):
    """The five nearest of all vectors to each query: every vector whose id is divisible by 100."""
    points = table(spark, d, "embeddings")
    return op.nearest(points, points.where("vec_id % 100 = 0"), 5).withColumn("distance", F.round("distance", 4)).withColumn("r", F.col("r").cast("long"))


@query("e15_intrinsic_dimension", KNN + """, m AS (SELECT q, count(*) AS m, max(distance) AS far, sum(ln(distance)) AS logs FROM k WHERE distance > 0 GROUP BY 1), x AS (SELECT (m - 1) / (m * ln(far) - logs) AS dim FROM m WHERE m >= 2 AND m * ln(far) > logs)
 SELECT round(avg(dim), 4) AS mean_dim, round(stddev_pop(dim), 4) AS std_dim, count(*) AS valid FROM x""")
def e15(spark, d):
    points = table(spark, d, "embeddings")
    return op.intrinsic_dimension(op.nearest(points, points.where("vec_id % 100 = 0"), 5)).select(F.round("mean_dim", 4).alias("mean_dim"), F.round("std_dim", 4).alias("std_dim"), "valid")
