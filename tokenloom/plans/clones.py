"""Queries: clone detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import clones as op
from ..sources.corpus import document_functions
from .registry import query

SIZES, THRESHOLDS, PERMS = (3, 4, 5), (0.7, 0.9), op.PERMUTATIONS
VALUES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(op.constants(PERMS)))


def _sets(k: int) -> str:
    """Common table s{k}(func, shingle): the distinct k-grams."""
    shifts = "".join(f", lead(opcode, {i}) OVER o AS o{i}" for i in range(1, k))
    said = " || ' ' || ".join(["opcode", *(f"o{i}" for i in range(1, k))])
    return f"""w{k} AS (SELECT func, opcode{shifts} FROM tok WINDOW o AS (PARTITION BY func ORDER BY i)),
 s{k} AS MATERIALIZED (SELECT DISTINCT func, {said} AS shingle FROM w{k} JOIN z USING (func) WHERE o{k - 1} IS NOT NULL AND n >= {op.MIN_OPS})"""


def _signed(k: int) -> str:
    return f"""h{k} AS (SELECT func, ('0x' || substr(md5(shingle), 1, 8))::BIGINT AS h FROM s{k}), m{k} AS MATERIALIZED (SELECT func, perm, min((h * a + b) % {op.PRIME}) AS value FROM h{k}, c GROUP BY 1, 2)"""


def _near(k: int, t: float) -> str:
    """Common table q{k}_{t}(id1, id2, estimate): the candidates of one shingle size and threshold."""
    b, r = op.band_shape(t, PERMS)
    n = f"{k}_{round(t * 100)}"
    return f"""g{n} AS (SELECT sig, min(func) AS head FROM l{k} GROUP BY 1), b{n} AS (SELECT head, sig, i AS band, list_slice(sig, i * {r} + 1, i * {r} + {r}) AS h FROM g{n}, range({b}) t(i)),
 p{n} AS (SELECT DISTINCT x.head AS id1, y.head AS id2, x.sig AS s1, y.sig AS s2 FROM b{n} x JOIN b{n} y ON x.band = y.band AND x.h = y.h AND x.head < y.head),
 q{n} AS (SELECT id1, id2, list_sum(list_transform(list_zip(s1, s2), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) / {PERMS} AS estimate FROM p{n} UNION ALL SELECT head, func, 1.0 FROM l{k} JOIN g{n} USING (sig) WHERE func <> head)"""


def _listed(k: int) -> str:
    return f"l{k} AS MATERIALIZED (SELECT func, list(value ORDER BY perm) AS sig FROM m{k} GROUP BY 1)"


def _measured(k: int) -> str:
    pairs = " UNION ".join(f"SELECT id1, id2 FROM q{k}_{round(t * 100)}" for t in THRESHOLDS)
    return f"""ss{k} AS (SELECT func, list(shingle) AS l FROM s{k} GROUP BY 1), j{k} AS (SELECT id1, id2, len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l))) AS jaccard FROM ({pairs}) JOIN ss{k} a ON a.func = id1 JOIN ss{k} b ON b.func = id2)"""


START = f"WITH {{TOK}}, z AS (SELECT func, any_value(binary) AS binary, count(*) AS n FROM tok GROUP BY 1), c(perm, a, b) AS (VALUES {VALUES}), "
SETS = START + _sets(3)
SIGNED = SETS + ", " + _signed(3)
#: jj(id1, id2, jaccard): the best similarity of each candidate over all shingle sizes and both thresholds.
JACCARD = "".join(", " + x for k in SIZES for x in ((_sets(k), _signed(k)) if k != 3 else ()) + (_listed(k), *(_near(k, t) for t in THRESHOLDS), _measured(k)))
JACCARD += ", jj AS MATERIALIZED (SELECT id1, id2, max(jaccard) AS jaccard FROM (" + " UNION ALL ".join(f"SELECT * FROM j{k}" for k in SIZES) + ") GROUP BY 1, 2) "


@query("f01_shingles", SETS + " SELECT func, count(*) AS shingles FROM s3 GROUP BY 1")
def f01(spark, d):
    return op.shingled(document_functions(spark, d), 3).select("func", F.size("shingles").cast("long").alias("shingles"))


@query("f02_minhash_signatures", SIGNED + " SELECT func, perm, CAST(value AS BIGINT) AS value FROM m3")
def f02(spark, d):
    return op.signatures(op.shingled(document_functions(spark, d), 3)).select("func", F.posexplode("sig").alias("perm", "value"))


@query("f03_lsh_candidates", SIGNED + ", " + _listed(3) + ", " + _near(3, 0.7) + " SELECT id1, id2, round(estimate, 6) AS estimate FROM q3_70")
def f03(spark, d):
    signed = op.written(op.signatures(op.shingled(document_functions(spark, d), 3)), "signatures")
    return op.candidates(signed, 0.7).withColumn("estimate", r6(F.col("estimate")))


def _pairs(spark, d):
    functions = document_functions(spark, d)
    return functions, op.written(op.best_pairs(functions, SIZES, THRESHOLDS), "pairs")


@query("f04_clone_jaccard", SIGNED + JACCARD + "SELECT id1, id2, round(jaccard, 6) AS jaccard FROM jj")
def f04(spark, d):
    return _pairs(spark, d)[1].select("id1", "id2", r6(F.col("jaccard")).alias("jaccard"))


@query("b12_clone_type", """WITH g AS (SELECT (i % 101) / 100 AS j, (i // 101) / 100 AS s FROM range(10201) t(i)), b AS (SELECT j, s, CASE WHEN j < 0.5 OR s < 0.3 THEN 0 WHEN j >= 0.95 THEN 1 WHEN j >= 0.7 THEN 2 ELSE 3 END AS t FROM g)
 SELECT round(j, 2) AS jaccard, round(s, 2) AS alignment, CASE WHEN t > 0 AND abs(j - s) > 0.3 THEN least(t + 1, 3) ELSE t END AS clone_type FROM b""")
def b12(spark, d):
    """Types over a grid of both measures."""
    grid = spark.range(10201).select(((F.col("id") % 101) / 100).alias("j"), (F.floor(F.col("id") / 101) / 100).alias("s"))
    return grid.select(F.round("j", 2).alias("jaccard"), F.round("s", 2).alias("alignment"), op.clone_type(F.col("j"), F.col("s")).cast("int").alias("clone_type"))


@query("f09_clone_components", SIGNED + JACCARD + """, e AS (SELECT id1 AS a, id2 AS b FROM jj WHERE jaccard >= 0.5 UNION SELECT id2, id1 FROM jj WHERE jaccard >= 0.5), r AS (WITH RECURSIVE t AS (SELECT a, a AS c FROM e UNION SELECT e.a, t.c FROM t JOIN e ON e.b = t.a) SELECT * FROM t)
 SELECT a AS node, min(c) AS component FROM r GROUP BY 1""")
def f09(spark, d):
    return op.components(_pairs(spark, d)[1].where("jaccard >= 0.5"))


@query("d38_clone_density", SIGNED + JACCARD + """, cl AS (SELECT id1 AS func FROM jj WHERE jaccard >= 0.5 UNION SELECT id2 FROM jj WHERE jaccard >= 0.5) SELECT binary, count(*) AS functions, count(cl.func) AS cloned, round(count(cl.func) / count(*), 6) AS density FROM z LEFT JOIN cl USING (func) GROUP BY 1""")
def d38(spark, d):
    functions, pairs = _pairs(spark, d)
    near = pairs.where("jaccard >= 0.5")
    cloned = near.select(F.explode(F.array("id1", "id2")).alias("func")).distinct().withColumn("c", F.lit(1))
    rows = functions.select("binary", "func").join(cloned, "func", "left").groupBy("binary").agg(F.count("*").alias("functions"), F.count("c").alias("cloned"))
    return rows.withColumn("density", r6(F.col("cloned") / F.col("functions")))


@query("d39_cross_matrix", SIGNED + JACCARD + """, k AS (SELECT a.binary AS x, b.binary AS y FROM jj JOIN z a ON a.func = id1 JOIN z b ON b.func = id2 WHERE jaccard >= 0.5), s2 AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k WHERE x <> y) SELECT x AS binary1, y AS binary2, count(*) AS pairs FROM s2 GROUP BY 1, 2""")
def d39(spark, d):
    functions, pairs = _pairs(spark, d)
    b = functions.select("func", "binary")
    k = pairs.where("jaccard >= 0.5").join(b.toDF("id1", "x"), "id1").join(b.toDF("id2", "y"), "id2").select("x", "y")
    return k.union(k.where("x <> y").select("y", "x")).groupBy(F.col("x").alias("binary1"), F.col("y").alias("binary2")).agg(F.count("*").alias("pairs"))


def _typed(spark, d):
    """No alignment makes a clone of what is below 0.5."""
    functions, pairs = _pairs(spark, d)
    rows = op.aligned(pairs.where("jaccard >= 0.5"), functions).withColumn("clone_type", op.clone_type(F.col("jaccard"), F.col("alignment")))
    return functions, op.written(rows.where("clone_type > 0"), "clone-pairs")


@query("f07_clone_pairs")
def f07(spark, d):
    """Aligned and typed clone pairs."""
    functions, pairs = _typed(spark, d)
    b = functions.select("func", "binary")
    rows = pairs.join(b.toDF("id1", "binary1"), "id1").join(b.toDF("id2", "binary2"), "id2")
    return rows.withColumn("cross_binary", F.col("binary1") != F.col("binary2"))


@query("f10_clone_families")
def f10(spark, d):
    functions, pairs = _typed(spark, d)
    return op.families(pairs, op.components(pairs), functions)


@query("d37_clone_summary")
def d37(spark, d):
    functions, pairs = _typed(spark, d)
    parts = op.components(pairs)
    f = parts.groupBy("component").agg(F.count("*").alias("size"))
    total = functions.agg(F.count("*").alias("functions"))
    p = pairs.agg(F.count("*").alias("pairs"), *(F.sum((F.col("clone_type") == t).cast("long")).alias(f"type_{t}") for t in (1, 2, 3)))
    s = f.agg(F.count("*").alias("families"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), F.sum("size").alias("cloned"))
    return p.crossJoin(s).crossJoin(total).withColumn("clone_fraction", F.col("cloned") / F.col("functions"))
