"""Queries: corpus scans, samples, rollups, fast summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy, r6
from ..operators import sampling as op
from ..operators.frequency import ngram_counts, opcode_frequency, ranked
from ..sources.corpus import document_functions, event_functions, normalise, positions, table
from ..streaming.frequency import windowed_frequency
from .registry import query


@query("a05_inode_dedup", "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def a05(spark, d):
    """The first document of each content."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("inode"), "doc_id", "lang", "source", "n_chars")
    return op.first_of(rows, "inode", "doc_id").drop("inode")


@query("a06_size_capped_scan", "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents WHERE n_chars <= 10000) WHERE r = 1 ORDER BY doc_id LIMIT 30")
def a06(spark, d):
    """The first thirty distinct documents below a size, in order."""
    rows = table(spark, d, "documents").where("n_chars <= 10000").select(F.md5("text").alias("inode"), "doc_id", "n_chars")
    return op.first_of(rows, "inode", "doc_id").select("doc_id", "n_chars").orderBy("doc_id").limit(30)


@query("b01_normalise", "SELECT page_id, lower(split_part(split_part(url, '@', 1), '.', 1)) AS opcode FROM pages")
def b01(spark, d):
    return table(spark, d, "pages").select("page_id", normalise(F.col("url")).alias("opcode"))


@query("b05_length_filters", """WITH {TOK}, z AS (SELECT func, count(*) AS n FROM tok GROUP BY 1) SELECT count(*) AS functions, count(*) FILTER (n >= 2) AS with_bigrams, count(*) FILTER (n >= 4) AS with_motifs, count(*) FILTER (n >= 10) AS hashed, count(*) FILTER (n >= 40) AS positional FROM z""")
def b05(spark, d):
    n = F.size("ops")
    some = lambda k: F.sum((n >= k).cast("long"))
    return document_functions(spark, d).agg(F.count("*").alias("functions"), some(2).alias("with_bigrams"), some(4).alias("with_motifs"), some(10).alias("hashed"), some(40).alias("positional"))


@query("b06_prefix_cap", "WITH {TOK} SELECT binary, count(*) AS kept, max(opcode) AS last_word FROM pos WHERE pos < 1000 GROUP BY 1")
def b06(spark, d):
    from ..sources.corpus import prefixes

    return prefixes(document_functions(spark, d), 1000).select("binary", F.size("ops").cast("long").alias("kept"), F.array_max("ops").alias("last_word"))


@query("b07_stride_sample", """WITH {TOK}, z AS (SELECT binary, greatest(1, count(*) // 100) AS step FROM tok GROUP BY 1) SELECT binary, pos, opcode FROM pos JOIN z USING (binary) WHERE pos % step = 0 AND pos // step < 100""")
def b07(spark, d):
    return op.stride_sample(positions(document_functions(spark, d)), 100)


IMPORTANCE = """WITH {EVT}, a AS (SELECT *, coalesce(CAST(func <> lag(func) OVER o AS INT), 0) AS boundary, coalesce(opcode <> lag(opcode) OVER o, false) AS change, list(opcode) OVER (PARTITION BY binary ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS l FROM pos WINDOW o AS (PARTITION BY binary ORDER BY pos)),
 w AS (SELECT *, power(3, sum(boundary) OVER (PARTITION BY binary ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) * CASE WHEN change THEN 1.5 ELSE 1 END * CASE WHEN len(list_distinct(l)) / 20 > 0.7 THEN 1.2 ELSE 1 END AS weight FROM a) """


@query("b08_importance_weights", IMPORTANCE + "SELECT binary, func, pos, opcode, round(weight, 6) AS weight FROM w")
def b08(spark, d):
    return op.importance(positions(event_functions(spark, d))).withColumn("weight", r6(F.col("weight")))


@query("b08_importance_sample", IMPORTANCE + ", k AS (SELECT *, row_number() OVER (PARTITION BY binary ORDER BY ln((('0x' || substr(md5('42|' || binary || '|' || CAST(pos AS VARCHAR)), 1, 8))::BIGINT + 1) / 4294967297) / weight DESC, pos) AS r FROM w) SELECT binary, func, pos, opcode FROM k WHERE r <= 10")
def b08b(spark, d):
    return op.weighted_sample(op.importance(positions(event_functions(spark, d))), 10).drop("weight")


@query("b13_category_inference", """SELECT page_id, CASE WHEN contains(lower(url), 'spam') THEN 'spam' WHEN contains(lower(url), '.org') THEN 'org' WHEN contains(lower(url), '.net') THEN 'net' WHEN contains(lower(url), '.com') THEN 'com' ELSE 'other' END AS category FROM pages""")
def b13(spark, d):
    """The first category whose pattern the name holds."""
    name, out = F.lower("url"), None
    for pattern, category in (("spam", "spam"), (".org", "org"), (".net", "net"), (".com", "com")):
        out = F.when(name.contains(pattern), category) if out is None else out.when(name.contains(pattern), category)
    return table(spark, d, "pages").select("page_id", out.otherwise("other").alias("category"))


@query("b15_label_parse", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS cc, split_part(o_orderpriority, '-', -1) AS opt FROM orders")
def b15(spark, d):
    parts = F.split("o_orderpriority", "-")
    return table(spark, d, "orders").select("o_orderkey", parts[0].alias("cc"), F.element_at(parts, -1).alias("opt"))


@query("d43_opt_trends", """WITH p AS (SELECT l_returnflag AS opt, l_linestatus AS project, l_quantity AS n, l_discount AS ratio FROM lineitem)
 SELECT opt, project, count(*) AS binaries, round(avg(n), 4) AS mean_instructions, round(avg(ratio), 6) AS mean_ratio FROM p GROUP BY GROUPING SETS ((opt), (opt, project))""")
def d43(spark, d):
    table(spark, d, "lineitem").select(F.col("l_returnflag").alias("opt"), F.col("l_linestatus").alias("project"), "l_quantity", "l_discount").createOrReplaceTempView("opt_trends")
    rows = spark.table("opt_trends").groupingSets([["opt"], ["opt", "project"]], "opt", "project")
    return rows.agg(F.count("*").alias("binaries"), F.round(F.avg("l_quantity"), 4).alias("mean_instructions"), r6(F.avg("l_discount")).alias("mean_ratio"))


@query("f23_pair_classes", """WITH n AS (SELECT s_suppkey AS id, s_nationkey AS project, s_suppkey % 3 AS compiler, s_acctbal AS x FROM supplier), p AS (SELECT CASE WHEN a.project = b.project THEN 'within_project' WHEN a.compiler = b.compiler THEN 'within_compiler' ELSE 'between' END AS class, abs(a.x - b.x) AS dist FROM n a JOIN n b ON a.id < b.id)
 SELECT class, count(*) AS n, round(avg(dist), 4) AS mean FROM p GROUP BY 1""")
def f23(spark, d):
    """Pairs of a few labelled items by what they share."""
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 3).alias("compiler"), F.col("s_acctbal").alias("x"))
    p = n.alias("a").join(n.alias("b"), F.col("a.id") < F.col("b.id"))
    kind = F.when(F.col("a.project") == F.col("b.project"), "within_project").when(F.col("a.compiler") == F.col("b.compiler"), "within_compiler").otherwise("between")
    return p.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("a.x") - F.col("b.x"))), 4).alias("mean"))


FAST = """WITH {TOK}, c AS (SELECT binary, opcode, count(*) AS n FROM tok GROUP BY 1, 2), v AS (SELECT binary, sum(n) AS t, count(*) AS u, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY 1) """


@query("d44_fast_summary", FAST + "SELECT binary, CAST(t AS BIGINT) AS total, u AS unique_opcodes, round(h, 6) AS entropy, round(CASE WHEN u > 1 THEN h / log2(u) ELSE 1 END, 6) AS compression_estimate, round(u / t, 6) AS unique_ratio FROM v")
def d44(spark, d):
    c = opcode_frequency(document_functions(spark, d), ("binary",))
    v = c.groupBy("binary").agg(F.sum("count").alias("total"), F.count("*").alias("unique_opcodes"), entropy().alias("entropy"))
    estimate = F.when(F.col("unique_opcodes") > 1, F.col("entropy") / F.log2(F.col("unique_opcodes").cast("double"))).otherwise(1.0)
    return v.select("binary", "total", "unique_opcodes", r6(F.col("entropy")).alias("entropy"), r6(estimate).alias("compression_estimate"), r6(F.col("unique_opcodes") / F.col("total")).alias("unique_ratio"))


@query("d46_fast_merge", FAST + ", r AS (SELECT *, row_number() OVER (PARTITION BY binary ORDER BY n DESC, opcode) AS rn FROM c), m AS (SELECT opcode, CAST(sum(n) AS BIGINT) AS count FROM r WHERE rn <= 50 GROUP BY 1) SELECT opcode, count FROM m ORDER BY count DESC, opcode LIMIT 20")
def d46(spark, d):
    """Approximate by design: the binaries' fifty most frequent opcodes, merged. d01 is exact."""
    top = ranked(opcode_frequency(document_functions(spark, d), ("binary",)), ("binary",)).where("rank <= 50")
    return top.groupBy("opcode").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "opcode").limit(20)


@query("d47_unique_ngrams", """WITH {TOK}, w AS (SELECT binary, opcode, lead(opcode) OVER o AS o2, lead(opcode, 2) OVER o AS o3 FROM pos WINDOW o AS (PARTITION BY binary ORDER BY pos)), g AS (SELECT binary, 2 AS n, opcode || ' ' || o2 AS x FROM w WHERE o2 IS NOT NULL UNION ALL SELECT binary, 3, opcode || ' ' || o2 || ' ' || o3 FROM w WHERE o3 IS NOT NULL)
 SELECT binary, n, count(DISTINCT x) AS unique_ngrams, count(*) AS total FROM g GROUP BY 1, 2""")
def d47(spark, d):
    c = ngram_counts(document_functions(spark, d), [2, 3])
    return c.groupBy("binary", "n").agg(F.count("*").alias("unique_ngrams"), F.sum("count").alias("total"))


@query("c15_label_join", "SELECT coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def c15(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"), "lang").agg(F.count("*").alias("n"))


@query("k01_windowed_frequency", "SELECT date_trunc('day', ts) AS start, event_type AS opcode, count(*) AS count FROM events GROUP BY 1, 2")
def k01(spark, d):
    """The batch twin of the streaming query."""
    return windowed_frequency(table(spark, d, "events"))


@query("n05_group_comparison", """WITH l AS (SELECT lang, n_chars, doc_id FROM documents), g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m FROM l GROUP BY 1 HAVING count(*) >= 5), t AS (SELECT count(*) AS k, sum(m) AS s FROM g)
 SELECT lang, n, round(m, 4) AS mean, round(m / ((s - m) / (k - 1)), 6) AS ratio, m / ((s - m) / (k - 1)) > 2 OR m / ((s - m) / (k - 1)) < 0.5 AS distinctive FROM g, t""")
def n05(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m")).where("n >= 5")
    every = Window.partitionBy()  # a row for each group
    ratio = F.col("m") / ((F.sum("m").over(every) - F.col("m")) / (F.count("*").over(every) - 1))
    return g.withColumn("r", ratio).select("lang", "n", F.round("m", 4).alias("mean"), r6(F.col("r")).alias("ratio"), ((F.col("r") > 2) | (F.col("r") < 0.5)).alias("distinctive"))


@query("n08_cross_validated_entropy", """WITH {TOK}, c AS (SELECT func % 5 AS fold, opcode, count(*) AS n FROM tok GROUP BY 1, 2) SELECT fold, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1""")
def n08(spark, d):
    from ..sources.corpus import token_rows

    c = token_rows(document_functions(spark, d)).groupBy((F.col("func") % 5).alias("fold"), "opcode").agg(F.count("*").alias("count"))
    return c.groupBy("fold").agg(r6(entropy()).alias("entropy"))


@query("n09_f_ratio", """WITH l AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id)), g AS (SELECT quality, count(*) AS n, avg(n_chars) AS m, var_pop(n_chars) AS v FROM l GROUP BY 1), t AS (SELECT avg(n_chars) AS gm, count(*) AS nn FROM l)
 SELECT round((sum(n * power(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (any_value(nn) - count(*))), 6) AS f_ratio FROM g, t""")
def n09(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    g = rows.groupBy("quality").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"), F.var_pop("n_chars").alias("v"), F.sum("n_chars").alias("s"))
    every = Window.partitionBy()  # a row for each label
    g = g.withColumn("gm", F.sum("s").over(every) / F.sum("n").over(every))
    between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2))) / (F.count("*") - 1), F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count("*"))
    return g.agg(r6(between / within).alias("f_ratio"))
