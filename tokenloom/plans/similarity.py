"""Queries: cosine, separation, clustering scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, r6
from ..operators import similarity as op
from ..operators.clones import written
from ..operators.frequency import ngram_counts
from ..operators.ngram_blocks import counts_of, top_ngrams
from ..sources.corpus import document_functions, table
from .frequency import GRAMS
from .registry import query


def _numbered(n: int, k: str | None = None) -> str:
    """The cosines s of n-grams; their names carry the number k."""
    k = str(n) if k is None else k
    return f""", c{k} AS (SELECT binary, ngram, count(*) AS c FROM g WHERE n = {n} GROUP BY 1, 2), top{k} AS (SELECT ngram FROM c{k} GROUP BY 1 ORDER BY sum(c) DESC, ngram LIMIT 10000),
     tf{k} AS (SELECT binary, ngram, c / sum(c) OVER (PARTITION BY binary) AS tf FROM c{k} JOIN top{k} USING (ngram)), nm{k} AS (SELECT binary, sqrt(sum(tf * tf)) AS norm FROM tf{k} GROUP BY 1), x{k} AS (SELECT binary, ngram, tf / norm AS x FROM tf{k} JOIN nm{k} USING (binary)),
     s{k} AS (SELECT a.binary AS a, b.binary AS b, sum(a.x * b.x) AS similarity FROM x{k} a JOIN x{k} b ON a.ngram = b.ngram AND a.binary < b.binary GROUP BY 1, 2) """


def _cosine_sql(n: int) -> str:
    return GRAMS + _numbered(n, "")


def tf(spark, d, n: int):
    return op.term_frequencies(ngram_counts(document_functions(spark, d), [n]).drop("n"))


def _cosine_query(n: int):
    @query(f"f19_cosine_n{n}", _cosine_sql(n) + "SELECT a, b, round(similarity, 6) AS similarity, round(1 - similarity, 6) AS distance FROM s")
    def run(spark, d):
        return op.cosine(tf(spark, d, n)).select("a", "b", r6(F.col("similarity")).alias("similarity"), r6(F.col("distance")).alias("distance"))


for _n in (2, 3, 4):
    _cosine_query(_n)


@query("f18_tf_matrix", _cosine_sql(2) + "SELECT binary, ngram, round(tf, 9) AS tf FROM tf")
def f18(spark, d):
    return tf(spark, d, 2).withColumn("tf", F.round("tf", 9))


@query("f20_top_features", _cosine_sql(2) + ", r AS (SELECT *, row_number() OVER (PARTITION BY binary ORDER BY tf DESC, ngram) AS rn FROM tf) SELECT binary, ngram, round(tf, 6) AS tf, rn FROM r WHERE rn <= 5")
def f20(spark, d):
    rn = F.row_number().over(Window.partitionBy("binary").orderBy(F.desc("tf"), "ngram")).cast("long")
    return tf(spark, d, 2).withColumn("rn", rn).where("rn <= 5").withColumn("tf", r6(F.col("tf")))


@query("d36_cosine_stats", _cosine_sql(2) + "SELECT round(avg(1 - similarity), 6) AS mean, round(stddev_pop(1 - similarity), 6) AS std, round(min(1 - similarity), 6) AS min, round(max(1 - similarity), 6) AS max, round(quantile_cont(1 - similarity, 0.5), 6) AS median, count(*) AS pairs FROM s")
def d36(spark, d):
    s = op.matrix_stats(op.cosine(tf(spark, d, 2)))
    return s.select(*(r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "median")), "pairs")


@query("i01_top_pairs", _cosine_sql(2) + """, r AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9) DESC, a, b) AS hi, row_number() OVER (ORDER BY round(similarity, 9), a, b) AS lo FROM s)
 SELECT 'most_similar' AS kind, a, b, round(similarity, 6) AS similarity, hi AS rn FROM r WHERE hi <= 5 UNION ALL SELECT 'most_different', a, b, round(similarity, 6), lo FROM r WHERE lo <= 5""")
def i01(spark, d):
    s = op.cosine(tf(spark, d, 2)).withColumn("k", F.round("similarity", 9))
    best = s.orderBy(F.desc("k"), "a", "b").limit(5).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("k"), "a", "b")))
    worst = s.orderBy("k", "a", "b").limit(5).withColumn("rn", F.row_number().over(Window.orderBy("k", "a", "b")))
    pick = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "a", "b", r6(F.col("similarity")).alias("similarity"), F.col("rn").cast("long").alias("rn"))
    return pick(best, "most_similar").union(pick(worst, "most_different"))


SEPARATION = """, p AS (SELECT *, round(1 - similarity, 9) AS dist, split_part(a, '/', 2) = split_part(b, '/', 2) AS within FROM s), k AS (SELECT *, rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2 AS rk FROM p),
 m AS (SELECT count(*) FILTER (within) AS n1, count(*) FILTER (NOT within) AS n2, avg(dist) FILTER (within) AS m1, avg(dist) FILTER (NOT within) AS m2, sum(rk) FILTER (within) AS r1 FROM k) """


@query("f22_category_separation", _cosine_sql(2) + SEPARATION + "SELECT n1 AS n_within, n2 AS n_between, round(m1, 6) AS mean_within, round(m2, 6) AS mean_between, r1 - n1 * (n1 + 1) / 2 AS u, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS effect_r FROM m")
def f22(spark, d):
    s = op.cosine(tf(spark, d, 2)).withColumn("distance", F.round("distance", 9))
    s = s.withColumn("within", F.substring_index("a", "/", -1) == F.substring_index("b", "/", -1))
    m = op.mann_whitney(s)
    return m.select("n_within", "n_between", r6(F.col("mean_within")).alias("mean_within"), r6(F.col("mean_between")).alias("mean_between"), "u", r6(F.col("effect_r")).alias("effect_r"))


@query("d35_category_means", _cosine_sql(2) + """SELECT split_part(a, '/', 2) AS category, count(*) AS pairs, round(avg(1 - similarity), 6) AS mean_within FROM s WHERE split_part(a, '/', 2) = split_part(b, '/', 2) GROUP BY 1""")
def d35(spark, d):
    s = op.cosine(tf(spark, d, 2)).withColumn("category", F.substring_index("a", "/", -1)).where(F.col("category") == F.substring_index("b", "/", -1))
    return s.groupBy("category").agg(F.count("*").alias("pairs"), r6(F.avg("distance")).alias("mean_within"))


@query("f25_method_consistency", _cosine_sql(2) + _numbered(3) + """ SELECT 'cosine_2gram' AS m1, 'cosine_3gram' AS m2, round(corr(s.similarity, s3.similarity), 6) AS correlation,
 CASE WHEN corr(s.similarity, s3.similarity) > 0.8 THEN 'High' WHEN corr(s.similarity, s3.similarity) > 0.6 THEN 'Good' WHEN corr(s.similarity, s3.similarity) > 0.4 THEN 'Moderate' ELSE 'Low' END AS label FROM s JOIN s3 USING (a, b)""")
def f25(spark, d):
    s = op.cosine(tf(spark, d, 2)).select("a", "b", F.col("similarity").alias("x")).join(op.cosine(tf(spark, d, 3)).select("a", "b", F.col("similarity").alias("y")), ["a", "b"])
    r = s.agg(F.corr("x", "y").alias("r"))
    return r.select(F.lit("cosine_2gram").alias("m1"), F.lit("cosine_3gram").alias("m2"), r6(F.col("r")).alias("correlation"), ladder(F.col("r"), [(0.8, "High"), (0.6, "Good"), (0.4, "Moderate")], "Low").alias("label"))


@query("e26_best_n", _cosine_sql(2) + _numbered(3) + _numbered(4) + """, e AS (SELECT 2 AS n, stddev_pop(1 - similarity) / greatest(avg(1 - similarity), 0.001) AS x FROM s UNION ALL SELECT 3, stddev_pop(1 - similarity) / greatest(avg(1 - similarity), 0.001) FROM s3
   UNION ALL SELECT 4, stddev_pop(1 - similarity) / greatest(avg(1 - similarity), 0.001) FROM s4) SELECT n, round(x, 6) AS separation FROM e ORDER BY round(x, 6) DESC, n LIMIT 1""")
def e26(spark, d):
    """The n whose distances spread most, for their mean; the smallest of equal ones."""
    functions, sizes = document_functions(spark, d), (2, 3, 4)
    counts = written(counts_of(functions, top_ngrams(functions, sizes, op.TOP_FEATURES)), "counts")
    each = None
    for n in sizes:
        m = op.matrix_stats(op.cosine(op.term_frequencies(counts.where(F.col("n") == n).drop("n")))).select(F.lit(n).alias("n"), r6(F.col("std") / F.greatest("mean", F.lit(0.001))).alias("separation"))
        each = m if each is None else each.union(m)
    return each.orderBy(F.desc("separation"), "n").limit(1)


@query("e22_silhouette", _cosine_sql(2) + """, b AS (SELECT a, b, 1 - similarity AS dist FROM s UNION ALL SELECT b, a, 1 - similarity FROM s), m AS (SELECT a, split_part(a, '/', 2) AS la, split_part(b, '/', 2) AS lb, avg(dist) AS m FROM b GROUP BY 1, 2, 3),
 e AS (SELECT a, min(CASE WHEN la = lb THEN m END) AS i, min(CASE WHEN la <> lb THEN m END) AS o FROM m GROUP BY 1) SELECT round(avg(CASE WHEN i IS NULL THEN 0 ELSE (o - i) / greatest(i, o) END), 6) AS silhouette, count(*) AS n FROM e WHERE o IS NOT NULL""")
def e22(spark, d):
    terms = tf(spark, d, 2)
    labels = terms.select("binary").distinct().select("binary", F.substring_index("binary", "/", -1).alias("label"))
    s = op.silhouette(labels, op.cosine(terms))
    return s.select(r6(F.col("silhouette")).alias("silhouette"), "n")


@query("e23_purity", """WITH l AS (SELECT source AS cluster, lang AS category FROM documents), c AS (SELECT cluster, category, count(*) AS n FROM l GROUP BY 1, 2)
 SELECT cluster, CAST(sum(n) AS BIGINT) AS size, arg_max(category, (n, category)) AS majority, round(max(n) / sum(n), 6) AS purity, CASE WHEN max(n) / sum(n) > 0.8 THEN 'Pure' WHEN max(n) / sum(n) > 0.5 THEN 'Mixed' ELSE 'Diverse' END AS label FROM c GROUP BY 1""")
def e23(spark, d):
    p = op.purity(table(spark, d, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("category")))
    return p.select("cluster", "size", "majority", r6(F.col("purity")).alias("purity"), ladder(F.col("purity"), [(0.8, "Pure"), (0.5, "Mixed")], "Diverse").alias("label"))


@query("e25_adjusted_rand", """WITH t AS (SELECT event_type AS x, dayofweek(ts) AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) * (sum(n) - 1) / 2 AS a FROM t),
 px AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM t GROUP BY x)), py AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM t GROUP BY y))
 SELECT round((i - px.p * py.p / a) / ((px.p + py.p) / 2 - px.p * py.p / a), 9) AS ari FROM i, px, py""")
def e25(spark, d):
    labels = table(spark, d, "events").select(F.col("event_type").alias("x"), F.dayofweek("ts").alias("y"))
    return op.adjusted_rand(labels).select(F.round("ari", 9).alias("ari"))


@query("f12_function_tfidf", """WITH {TOK}, w AS (SELECT func, opcode, lead(opcode) OVER o AS o2, lead(opcode, 2) OVER o AS o3 FROM tok WINDOW o AS (PARTITION BY func ORDER BY i)), t AS (SELECT func, opcode || ' ' || o2 || ' ' || o3 AS shingle, count(*) AS tf FROM w WHERE o3 IS NOT NULL GROUP BY 1, 2),
 top AS (SELECT shingle FROM t GROUP BY 1 ORDER BY sum(tf) DESC, shingle LIMIT 5000), k AS (SELECT t.* FROM t JOIN top USING (shingle)), n AS (SELECT count(DISTINCT func) AS docs FROM k), f AS (SELECT shingle, count(*) AS df FROM k GROUP BY 1),
 x AS (SELECT func, shingle, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS w FROM k JOIN f USING (shingle), n) SELECT func, shingle, round(w / sqrt(sum(w * w) OVER (PARTITION BY func)), 6) AS tfidf FROM x""")
def f12(spark, d):
    from ..functions.scalars import ngrams

    rows = document_functions(spark, d).where(F.size("ops") >= 3).select(F.col("func").alias("doc"), F.explode(ngrams("ops", 3)).alias("shingle")).groupBy("doc", "shingle").agg(F.count("*").alias("tf"))
    top = rows.groupBy("shingle").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "shingle").limit(5000).select("shingle")
    return op.tfidf(rows.join(F.broadcast(top), "shingle")).select(F.col("doc").alias("func"), "shingle", r6(F.col("tfidf")).alias("tfidf"))
