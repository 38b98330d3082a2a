"""Queries: motifs, positional profiles, fingerprints, language models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import structure as op
from ..sources.corpus import document_functions, event_functions
from .registry import query


def _motif_sql(k: int) -> str:
    leads = ", ".join(f"lead(opcode, {j}) OVER o AS o{j}" for j in range(1, k))
    joined = " || ' ' || ".join(["opcode", *(f"o{j}" for j in range(1, k))])
    return f"""WITH {{TOK}}, w AS (SELECT func, opcode, {leads} FROM tok WINDOW o AS (PARTITION BY func ORDER BY i)), g AS (SELECT func, {joined} AS motif FROM w WHERE o{k - 1} IS NOT NULL),
     f AS (SELECT count(DISTINCT func) AS functions FROM tok), c AS (SELECT motif, count(DISTINCT func) AS df, count(*) AS n FROM g GROUP BY 1),
     r AS (SELECT *, row_number() OVER (ORDER BY df * df / functions DESC, motif) AS rn FROM c, f WHERE df >= greatest(5, floor(functions * 0.005)) AND df >= greatest(1, floor(functions * 0.01)))
     SELECT {k} AS k, motif, df AS frequency, n AS total_occurrences, round(df / functions, 6) AS function_coverage, 'Generic pattern' AS annotation, rn FROM r WHERE rn <= 100"""


def _motif_query(k: int):
    @query(f"d20_motifs_k{k}", _motif_sql(k))
    def run(spark, d):
        return op.motifs(document_functions(spark, d), k).withColumn("function_coverage", r6(F.col("function_coverage")))


for _k in range(4, 13):
    _motif_query(_k)

POSITIONAL = """WITH {TOK}, s AS (SELECT func, i, opcode, count(*) OVER (PARTITION BY func) AS n FROM tok), p AS (SELECT 'start' AS side, i AS pos, opcode FROM s WHERE n >= 40 AND i < 20 UNION ALL SELECT 'end', n - 1 - i, opcode FROM s WHERE n >= 40 AND n - 1 - i < 20),
 c AS (SELECT side, pos, opcode, count(*) AS c FROM p GROUP BY 1, 2, 3) """


@query("d22_positional_distribution", POSITIONAL + ", r AS (SELECT *, row_number() OVER (PARTITION BY side, pos ORDER BY c DESC, opcode) AS rn, c / sum(c) OVER (PARTITION BY side, pos) AS p FROM c) SELECT side, pos, opcode, c AS count, round(p, 6) AS probability, rn FROM r WHERE rn <= 10")
def d22(spark, d):
    c = op.positional(document_functions(spark, d)).withColumn("pos", F.col("pos").cast("long"))
    at = Window.partitionBy("side", "pos")
    rows = c.withColumn("rn", F.row_number().over(at.orderBy(F.desc("count"), "opcode")).cast("long")).withColumn("probability", r6(F.col("count") / F.sum("count").over(at)))
    return rows.where("rn <= 10")


@query("d23_positional_entropy", POSITIONAL + "SELECT side, pos, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY 1, 2")
def d23(spark, d):
    return op.positional_entropy(op.positional(document_functions(spark, d))).select("side", F.col("pos").cast("long").alias("pos"), r6(F.col("entropy")).alias("entropy"))


@query("d24_consensus", POSITIONAL + ", r AS (SELECT *, row_number() OVER (PARTITION BY side, pos ORDER BY c DESC, opcode) AS rn FROM c) SELECT side, pos, max(CASE WHEN rn = 1 THEN opcode END) AS consensus, string_agg(opcode, ' ' ORDER BY rn) AS top3 FROM r WHERE rn <= 3 GROUP BY 1, 2")
def d24(spark, d):
    c = op.positional(document_functions(spark, d))
    rn = F.row_number().over(Window.partitionBy("side", "pos").orderBy(F.desc("count"), "opcode"))
    top = c.withColumn("rn", rn).where("rn <= 3").groupBy("side", F.col("pos").cast("long").alias("pos"))
    return top.agg(F.max(F.when(F.col("rn") == 1, F.col("opcode"))).alias("consensus"), F.array_join(F.array_sort(F.collect_list(F.struct("rn", "opcode"))).opcode, " ").alias("top3"))


@query("d25_positional_insights", POSITIONAL + """, e AS (SELECT side, pos, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, max(c) / sum(c) AS p FROM c GROUP BY 1, 2)
 SELECT side, round(avg(h) FILTER (pos < 5), 6) AS mean_entropy, CASE WHEN avg(h) FILTER (pos < 5) < 1 THEN 'High' WHEN avg(h) FILTER (pos < 5) < 2 THEN 'Medium' ELSE 'Low' END AS regularity, count(*) FILTER (pos < 10 AND p > 0.5) AS strong_positions FROM e GROUP BY 1""")
def d25(spark, d):
    c = op.positional(document_functions(spark, d))
    e = op.positional_entropy(c).join(c.groupBy("side", "pos").agg((F.max("count") / F.sum("count")).alias("p")), ["side", "pos"])
    mean = F.avg(F.when(F.col("pos") < 5, F.col("entropy")))
    label = F.when(mean < 1, "High").when(mean < 2, "Medium").otherwise("Low")
    return e.groupBy("side").agg(r6(mean).alias("mean_entropy"), label.alias("regularity"), F.sum(F.when((F.col("pos") < 10) & (F.col("p") > 0.5), 1).otherwise(0)).alias("strong_positions"))


#: The documents' words stand in for opcodes: each of the rules' opcodes is mapped to a frequent word.
STAND_INS = {"the": "movq", "of": "pushq", "and": "leaq", "to": "popq", "in": "addq", "is": "callq", "that": "retq", "de": "testq", "la": "cmpq", "der": "jmp", "die": "je", "le": "cmovl", "und": "vmov", "les": "ud2", "it": "jne"}


def stand_ins(functions):
    pairs = F.create_map(*(F.lit(x) for kv in STAND_INS.items() for x in kv))
    return functions.withColumn("ops", F.transform("ops", lambda x: F.coalesce(pairs[x], x)))


def _fingerprint_sql() -> str:
    case = "CASE opcode " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAND_INS.items()) + " ELSE opcode END"
    some = lambda names: "avg(CASE WHEN opcode IN (" + ", ".join(f"'{x}'" for x in names) + ") THEN 1.0 ELSE 0.0 END)"
    parts = {f"ratio_{x}": some([x]) for x in op.RATIO_OPCODES} | {
        "jump_ratio": some(op.JUMPS), "call_ratio": some(["callq"]), "ret_ratio": some(["retq"]), "vectorization_ratio": some(op.VECTOR), "lea_ratio": some(["leaq"]),
        "cmov_ratio": some(op.CONDITIONAL_MOVES), "push_pop_ratio": some(["pushq", "popq"]), "error_handling_ratio": some(op.ERRORS),
    }
    parts |= {f"prologue_{a}_{b}": f"count(*) FILTER (opcode = '{a}' AND o2 = '{b}') / greatest(count(*) - 1, 1)" for a, b in op.PROLOGUES}
    return f"""WITH {{TOK}}, m AS (SELECT binary, func, pos, {case} AS opcode FROM pos), w AS (SELECT *, lead(opcode) OVER (PARTITION BY binary ORDER BY pos) AS o2 FROM m),
     l AS (SELECT binary, func, count(*) AS n FROM m GROUP BY 1, 2), f AS (SELECT binary, avg(n) AS avg_function_length, stddev_pop(n) AS function_length_std, max(n) AS max_function_length, count(*) AS num_functions FROM l GROUP BY 1),
     x AS (SELECT binary, {", ".join(f"{v} AS {k}" for k, v in parts.items())}, CAST(count(*) AS BIGINT) AS total_instructions, count(DISTINCT opcode) AS unique_instructions, count(DISTINCT opcode) / count(*) AS unique_instruction_ratio FROM w GROUP BY 1),
     a AS (SELECT * FROM x JOIN f USING (binary)) """


FEATURES = [*(f"ratio_{x}" for x in op.RATIO_OPCODES), "jump_ratio", "call_ratio", "ret_ratio", "vectorization_ratio", "lea_ratio", "cmov_ratio", "push_pop_ratio", "error_handling_ratio", *(f"prologue_{a}_{b}" for a, b in op.PROLOGUES), "avg_function_length", "function_length_std", "unique_instruction_ratio"]
WHOLE = ["max_function_length", "num_functions", "total_instructions", "unique_instructions"]


@query("h01_fingerprint_features", _fingerprint_sql() + "SELECT binary, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + ", " + ", ".join(WHOLE) + " FROM a")
def h01(spark, d):
    x = op.fingerprint(stand_ins(document_functions(spark, d)))
    return x.select("binary", *(r6(F.col(c)).alias(c) for c in FEATURES), *(F.col(c).cast("long").alias(c) for c in WHOLE))


SCORES = """, s AS (SELECT binary, lea_ratio, least(CASE WHEN lea_ratio > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN ratio_addq > 0.1 THEN 0.2 ELSE 0 END + CASE WHEN prologue_pushq_movq > 0 THEN 0.2 ELSE 0 END, 1) AS gcc,
 least(CASE WHEN vectorization_ratio > 0.02 THEN 0.4 ELSE 0 END + CASE WHEN cmov_ratio > 0.005 THEN 0.3 ELSE 0 END + CASE WHEN ratio_testq > ratio_cmpq THEN 0.2 ELSE 0 END, 1) AS clang,
 least(CASE WHEN error_handling_ratio > 0.001 THEN 0.5 ELSE 0 END + CASE WHEN ratio_ud2 > 0 THEN 0.3 ELSE 0 END + CASE WHEN call_ratio > 0.1 THEN 0.2 ELSE 0 END, 1) AS rustc,
 least(CASE WHEN ratio_movq > 0.3 THEN 0.3 ELSE 0 END + CASE WHEN call_ratio > 0.1 THEN 0.2 ELSE 0 END + CASE WHEN lea_ratio < 0.01 THEN 0.2 ELSE 0 END + CASE WHEN cmov_ratio = 0 THEN 0.3 ELSE 0 END, 1) AS o0,
 least(CASE WHEN lea_ratio BETWEEN 0.01 AND 0.1 THEN 0.3 ELSE 0 END + CASE WHEN cmov_ratio > 0.002 THEN 0.3 ELSE 0 END + CASE WHEN jump_ratio BETWEEN 0.02 AND 0.1 THEN 0.2 ELSE 0 END + CASE WHEN push_pop_ratio < 0.2 THEN 0.2 ELSE 0 END, 1) AS o2,
 least(CASE WHEN vectorization_ratio > 0.01 THEN 0.4 ELSE 0 END + CASE WHEN lea_ratio > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN unique_instruction_ratio > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN cmov_ratio > 0.01 THEN 0.1 ELSE 0 END, 1) AS o3 FROM a),
 p AS (SELECT *, CASE WHEN gcc >= clang AND gcc >= rustc THEN 'gcc' WHEN clang >= rustc THEN 'clang' ELSE 'rustc' END AS compiler, CASE WHEN o0 >= o2 AND o0 >= o3 THEN 'O0' WHEN o2 >= o3 THEN 'O2' ELSE 'O3' END AS opt FROM s) """


@query("h02_fingerprint_prediction", _fingerprint_sql() + SCORES + "SELECT binary, compiler AS predicted_compiler, CAST(round(greatest(gcc, clang, rustc), 6) AS DOUBLE) AS compiler_confidence, opt AS predicted_optimization, CAST(round(greatest(o0, o2, o3), 6) AS DOUBLE) AS optimization_confidence FROM p")
def h02(spark, d):
    return op.predict(op.fingerprint(stand_ins(document_functions(spark, d)))).select("binary", "predicted_compiler", "compiler_confidence", "predicted_optimization", "optimization_confidence")


@query("d33_feature_aggregates", _fingerprint_sql() + SCORES + """, u AS (SELECT compiler, unnest(['lea_ratio', 'call_ratio', 'jump_ratio', 'unique_instruction_ratio']) AS feature, unnest([a.lea_ratio, a.call_ratio, a.jump_ratio, a.unique_instruction_ratio]) AS x FROM p JOIN a USING (binary))
 SELECT compiler AS predicted_compiler, feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM u GROUP BY 1, 2""")
def d33(spark, d):
    rows = op.predict(op.fingerprint(stand_ins(document_functions(spark, d))))
    long = rows.unpivot(["predicted_compiler"], ["lea_ratio", "call_ratio", "jump_ratio", "unique_instruction_ratio"], "feature", "x")
    return long.groupBy("predicted_compiler", "feature").agg(F.count("*").alias("n"), *(r6(f("x")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


@query("d32_distribution_counts", _fingerprint_sql() + SCORES + "SELECT compiler AS predicted_compiler, opt AS predicted_optimization, count(*) AS n, round(avg(greatest(gcc, clang, rustc)), 6) AS mean_confidence FROM p GROUP BY 1, 2")
def d32(spark, d):
    rows = op.predict(op.fingerprint(stand_ins(document_functions(spark, d))))
    return rows.groupBy("predicted_compiler", "predicted_optimization").agg(F.count("*").alias("n"), r6(F.avg("compiler_confidence")).alias("mean_confidence"))


def _lm_sql(n: int) -> str:
    before = " || ' ' || ".join(f"coalesce(lag(opcode, {j}) OVER o, '<BOS>')" for j in range(n - 1, 0, -1)) or "''"
    return f"""WITH {{EVT}}, z AS (SELECT binary, floor(count(*) * 0.8) AS cut FROM pos GROUP BY 1), x AS (SELECT binary, pos, {before} AS context, opcode AS token FROM pos WINDOW o AS (PARTITION BY binary ORDER BY pos)),
     t AS (SELECT context, token, count(*) AS c FROM x JOIN z USING (binary) WHERE pos < cut GROUP BY 1, 2), k AS (SELECT context, sum(c) AS ctx FROM t GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM t),
     s AS (SELECT x.binary, -log2((coalesce(c, 0) + 1) / (coalesce(ctx, 0) + v)) AS bits FROM x JOIN z USING (binary) LEFT JOIN t ON t.context = x.context AND t.token = x.token LEFT JOIN k ON k.context = x.context, v WHERE pos >= cut) """


def _lm_query(n: int):
    @query(f"e11_lm_n{n}", _lm_sql(n) + f"SELECT {n} AS n, count(*) AS tokens, round(avg(bits), 6) AS cross_entropy, round(power(2, avg(bits)), 6) AS perplexity FROM s")
    def run(spark, d):
        s = op.language_model(event_functions(spark, d), n).agg(F.sum("tokens").alias("tokens"), (F.sum("bits") / F.sum("tokens")).alias("ce"))
        return s.select(F.lit(n).alias("n"), "tokens", r6(F.col("ce")).alias("cross_entropy"), r6(F.pow(F.lit(2.0), "ce")).alias("perplexity"))


for _n in range(1, 6):
    _lm_query(_n)


@query("e11_lm_per_binary", _lm_sql(2) + "SELECT binary, count(*) AS tokens, round(avg(bits), 6) AS cross_entropy FROM s GROUP BY 1")
def e11b(spark, d):
    return op.language_model(event_functions(spark, d), 2).select("binary", "tokens", r6(F.col("bits") / F.col("tokens")).alias("cross_entropy"))


@query("e12_lm_vs_empirical", """WITH {EVT}, """ + _lm_sql(2).split("{EVT}, ", 1)[1] + """, h AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h1 FROM (SELECT count(*) AS c FROM pos GROUP BY opcode)),
 b AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h2 FROM (SELECT count(*) AS c FROM (SELECT opcode, lead(opcode) OVER (PARTITION BY binary ORDER BY pos) AS o2 FROM pos) WHERE o2 IS NOT NULL GROUP BY opcode, o2))
 SELECT 2 AS n, round((SELECT avg(bits) FROM s), 4) AS cross_entropy, round(h2 - h1, 4) AS empirical_conditional_entropy, round((SELECT avg(bits) FROM s) - (h2 - h1), 4) AS gap FROM h, b""")
def e12(spark, d):
    from ..operators.frequency import entropy_rates, ngram_frequencies

    functions = event_functions(spark, d)
    ce = op.language_model(functions, 2).agg((F.sum("bits") / F.sum("tokens")).alias("ce"))
    empirical = entropy_rates(ngram_frequencies(functions, [1, 2], ())).where("n = 2").select(F.col("conditional_entropy").alias("h"))
    return ce.crossJoin(empirical).select(F.lit(2).alias("n"), F.round("ce", 4).alias("cross_entropy"), F.round("h", 4).alias("empirical_conditional_entropy"), F.round(F.col("ce") - F.col("h"), 4).alias("gap"))


