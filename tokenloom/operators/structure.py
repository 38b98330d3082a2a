"""Motifs, positional profiles, fingerprints, language models."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy, ngrams
from ..sources.corpus import with_preceding

# Opcodes that the annotation and fingerprint rules look for.
BRANCHES = ["je", "jne", "jl", "jle", "jg", "jge", "jb", "jbe", "ja", "jae", "js", "jns", "jo", "jno", "jp", "jnp", "jmp"]
ARITHMETIC = ["add", "sub", "imul", "idiv"]
RATIO_OPCODES = [
    "movq", "movl", "pushq", "popq", "leaq", "addq", "subq", "testq", "cmpq", "jmp", "je", "jne", "callq", "retq", "vmov", "vadd", "vmul", "vxor", "ud2",
]
PROLOGUES = [("pushq", "movq"), ("endbr64", "pushq"), ("pushq", "leaq")]
JUMPS = ["jmp", "je", "jne", "jl", "jg", "jle", "jge"]
VECTOR = ["vmov", "vadd", "vmul", "vpadd", "vpxor", "vzeroupper"]
CONDITIONAL_MOVES = ["cmovl", "cmovg", "cmove", "cmovne", "cmovle", "cmovge"]
ERRORS = ["ud2", "panic", "abort"]


def annotate(ops: Column) -> Column:
    """The first rule that a motif's opcodes meet."""
    first, last = F.element_at(ops, 1), F.element_at(ops, -1)
    has = lambda op: F.array_contains(ops, op)
    many = lambda op: F.size(F.filter(ops, lambda x: x == op))
    one_of = lambda names: F.arrays_overlap(ops, F.array(*map(F.lit, names)))
    rules = [
        ((first == "push") & (F.size(ops) >= 2) & (F.get(ops, F.lit(1)) == "mov"), "Function prologue — stack frame setup"),
        (first == "push", "Function prologue — save register"),
        (has("leave") & has("ret"), "Function epilogue — leave/ret"),
        (has("pop") & has("ret"), "Function epilogue — pop/ret"),
        (last == "ret", "Function epilogue — return"),
        (has("cmp") & one_of(BRANCHES), "Loop/branch — compare and jump"),
        (has("test") & one_of(BRANCHES), "Loop/branch — test and jump"),
        (has("xor") & (F.size(ops) <= 3), "Register zeroing — xor idiom"),
        (has("call"), "Function call — subroutine invocation"),
        (many("mov") >= 3, "Data movement — bulk register/memory transfers"),
        (has("lea") & has("mov"), "Memory access — address calculation and load"),
        (one_of(ARITHMETIC), "Arithmetic — integer operations"),
        (many("push") >= 2, "Stack — multiple pushes"),
        (many("pop") >= 2, "Stack — multiple pops"),
    ]
    out = F.when(*rules[0])
    for test, label in rules[1:]:
        out = out.when(test, label)
    return out.otherwise("Generic pattern")


def motifs(functions: DataFrame, k: int, min_frequency: int | None = None, min_coverage: float = 0.01, top: int = 100) -> DataFrame:
    """k, motif, frequency (functions that hold it), total_occurrences, function_coverage, annotation, rn."""
    total = functions.agg(F.count("*").alias("functions"))
    held = functions.where(F.size("ops") >= k).select("binary", "func", F.explode(ngrams("ops", k)).alias("motif"))
    # A motif's functions are counted from its (motif, function) groups: no distinct aggregate, partial sums on the map side.
    counts = held.groupBy("motif", "binary", "func").agg(F.count("*").alias("n")).groupBy("motif").agg(F.count("*").alias("frequency"), F.sum("n").alias("total_occurrences"))
    least = F.lit(min_frequency) if min_frequency else F.greatest(F.lit(5), F.floor(F.col("functions") * 0.005))
    counts = counts.crossJoin(F.broadcast(total)).where((F.col("frequency") >= least) & (F.col("frequency") >= F.greatest(F.lit(1), F.floor(F.col("functions") * min_coverage))))
    score = F.col("frequency") * F.col("frequency") / F.col("functions")
    rn = F.row_number().over(Window.orderBy(F.desc("score"), "motif")).cast("long")  # motifs above the floors: 1/min_coverage times a function's length at most
    rows = counts.withColumn("score", score).withColumn("rn", rn).where(F.col("rn") <= top)
    return rows.select(F.lit(k).alias("k"), "motif", "frequency", "total_occurrences", (F.col("frequency") / F.col("functions")).alias("function_coverage"), annotate(F.split("motif", " ")).alias("annotation"), "rn")


#: Functions among which one round of motif_counts looks for candidates.
PART = 4096


def motif_counts(functions: DataFrame, sizes: range, share: float) -> DataFrame:
    """k, motif, frequency, total_occurrences of every motif that at least that share of all functions holds, and of some others.

    What a share of all functions holds, the same share of the functions of some part holds. So each part names its own,
    grown word by word (what is frequent has frequent beginnings and ends), and a second pass counts those that any part
    named: no n-gram is shuffled but these.
    """
    most = max(sizes)

    def found(docs):
        least, out = share * len(docs), []
        held = Counter(w for o in docs for w in {*o})
        good = {(w,) for w, n in held.items() if n >= least}
        places = [[i for i, w in enumerate(o) if (w,) in good] for o in docs]
        for k in range(2, most + 1):
            grams, held = [], Counter()
            for o, p in zip(docs, places, strict=True):
                both = {*p}
                each = [(i, tuple(o[i : i + k])) for i in p if i + 1 in both]
                grams.append(each)
                held.update({g for _, g in each})
            good = {g for g, n in held.items() if n >= least}
            places = [[i for i, g in each if g in good] for each in grams]
            if k in sizes:
                out += [(k, " ".join(g)) for g in good]
            if not good:
                break
        return out

    def name(batches):
        docs, out = [], set()
        for batch in batches:
            for o in batch.column(0):
                docs.append(o.as_py())
                if len(docs) == 2 * PART:  # no small part is left: it would name all that it holds
                    out.update(found(docs[:PART]))
                    docs = docs[PART:]
        out.update(found(docs) if docs else ())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([m for _, m in out], pa.string())], ["k", "motif"])

    ops = functions.select("ops")
    named = {(r.k, r.motif) for r in ops.mapInArrow(name, "k int, motif string").distinct().collect()}  # motifs of a share of a part: 1 / share times a function's length for each part at most
    first = min(sizes)
    begins = {" ".join(m.split(" ")[:first]) for _, m in named}

    def count(batches):
        frequency, total = Counter(), Counter()
        for batch in batches:
            for o in batch.column(0):
                o, own = o.as_py(), Counter()
                for i, begin in enumerate(map(" ".join, zip(*(o[j:] for j in range(first)), strict=False))):
                    if begin in begins:
                        for k in sizes:
                            if i + k <= len(o) and (k, motif := " ".join(o[i : i + k])) in named:
                                own[k, motif] += 1
                frequency.update(own.keys())
                total.update(own)
        rows = list(frequency)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([m for _, m in rows], pa.string()), pa.array([frequency[r] for r in rows], pa.int64()), pa.array([total[r] for r in rows], pa.int64())], ["k", "motif", "f", "t"])

    counts = ops.mapInArrow(count, "k int, motif string, f long, t long")
    return counts.groupBy("k", "motif").agg(F.sum("f").alias("frequency"), F.sum("t").alias("total_occurrences"))


def best_motifs(functions: DataFrame, sizes: range, top: int, min_coverage: float = 0.01) -> DataFrame:
    """The rows of motifs for each size, in two passes over the functions. A function is a row."""
    n = functions.count()
    least = max(5, int(n * 0.005), int(n * min_coverage))
    counts = motif_counts(functions, sizes, least / max(n, 1)).where(F.col("frequency") >= least)
    score = F.col("frequency") * F.col("frequency") / F.lit(n)
    rn = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "motif")).cast("long")
    rows = counts.withColumn("score", score).withColumn("rn", rn).where(F.col("rn") <= top)
    return rows.select("k", "motif", "frequency", "total_occurrences", (F.col("frequency") / F.lit(n)).alias("function_coverage"), annotate(F.split("motif", " ")).alias("annotation"), "rn")


def positional(functions: DataFrame, window: int = 20) -> DataFrame:
    """side, pos, opcode, count: the opcodes at each place from the start and from the end of functions of 2*window opcodes or more."""
    long = functions.where(F.size("ops") >= 2 * window)
    side = lambda name, part: long.select(F.lit(name).alias("side"), F.posexplode(part).alias("pos", "opcode"))
    both = side("start", F.slice("ops", 1, window)).union(side("end", F.reverse(F.slice("ops", -window, window))))
    return both.groupBy("side", "pos", "opcode").agg(F.count("*").alias("count"))


def positional_entropy(counts: DataFrame) -> DataFrame:
    return counts.groupBy("side", "pos").agg(entropy().alias("entropy"))


def fingerprint(functions: DataFrame) -> DataFrame:
    """35 features of each binary: one pass, one aggregate."""
    from ..sources.corpus import with_following

    count = lambda names: F.size(F.filter("ops", lambda x: x.isin(*names)))
    pairs = lambda a, b: F.size(F.filter(F.zip_with("ops", F.slice("line", 2, F.size("ops")), lambda x, y: F.coalesce((x == a) & (y == b), F.lit(False))), lambda x: x))
    rows = with_following(functions, 1).withColumn("line", F.concat("ops", "following"))
    sums = {f"ratio_{x}": [x] for x in RATIO_OPCODES} | {
        "jump_ratio": JUMPS, "call_ratio": ["callq"], "ret_ratio": ["retq"], "vectorization_ratio": VECTOR, "lea_ratio": ["leaq"], "cmov_ratio": CONDITIONAL_MOVES,
        "push_pop_ratio": ["pushq", "popq"], "error_handling_ratio": ERRORS,
    }
    prologues = {f"prologue_{a}_{b}": (a, b) for a, b in PROLOGUES}
    rows = rows.select("binary", F.size("ops").alias("n"), *(count(v).alias(k) for k, v in sums.items()), *(pairs(*v).alias(k) for k, v in prologues.items()))
    total = F.sum("n")
    features = rows.groupBy("binary").agg(
        *((F.sum(k) / total).alias(k) for k in sums), *((F.sum(k) / F.greatest(total - 1, F.lit(1))).alias(k) for k in prologues),
        F.avg("n").alias("avg_function_length"), F.stddev_pop("n").alias("function_length_std"), F.max("n").alias("max_function_length"), F.count("*").alias("num_functions"), total.alias("total_instructions"),
    )
    unique = functions.select("binary", F.explode("ops").alias("opcode")).groupBy("binary", "opcode").agg(F.lit(1).alias("x")).groupBy("binary").agg(F.count("*").alias("unique_instructions"))
    return features.join(unique, "binary").withColumn("unique_instruction_ratio", F.col("unique_instructions") / F.col("total_instructions"))


def predict(features: DataFrame) -> DataFrame:
    """Scores of compilers and optimisation levels, and the best of each; ties go to the first named."""
    c = F.col
    point = lambda test, x: F.when(test, x).otherwise(0.0)
    scores = {
        "gcc": [(c("lea_ratio") > 0.05, 0.3), (c("ratio_addq") > 0.1, 0.2), (c("prologue_pushq_movq") > 0, 0.2)],
        "clang": [(c("vectorization_ratio") > 0.02, 0.4), (c("cmov_ratio") > 0.005, 0.3), (c("ratio_testq") > c("ratio_cmpq"), 0.2)],
        "rustc": [(c("error_handling_ratio") > 0.001, 0.5), (c("ratio_ud2") > 0, 0.3), (c("call_ratio") > 0.1, 0.2)],
        "O0": [(c("ratio_movq") > 0.3, 0.3), (c("call_ratio") > 0.1, 0.2), (c("lea_ratio") < 0.01, 0.2), (c("cmov_ratio") == 0, 0.3)],
        "O2": [(c("lea_ratio").between(0.01, 0.1), 0.3), (c("cmov_ratio") > 0.002, 0.3), (c("jump_ratio").between(0.02, 0.1), 0.2), (c("push_pop_ratio") < 0.2, 0.2)],
        "O3": [(c("vectorization_ratio") > 0.01, 0.4), (c("lea_ratio") > 0.05, 0.3), (c("unique_instruction_ratio") > 0.5, 0.2), (c("cmov_ratio") > 0.01, 0.1)],
    }
    rows = features.select("*", *(F.round(F.least(sum((point(*r) for r in rules), F.lit(0.0)), F.lit(1.0)), 6).alias(f"score_{k}") for k, rules in scores.items()))

    def best(names: list[str]) -> Column:
        top = F.greatest(*(c(f"score_{n}") for n in names))
        return F.coalesce(*(F.when(c(f"score_{n}") == top, F.lit(n)) for n in names))

    rows = rows.withColumn("predicted_compiler", best(["gcc", "clang", "rustc"])).withColumn("predicted_optimization", best(["O0", "O2", "O3"]))
    return rows.withColumn("compiler_confidence", F.greatest("score_gcc", "score_clang", "score_rustc")).withColumn("optimization_confidence", F.greatest("score_O0", "score_O2", "score_O3"))


def contexts(functions: DataFrame, n: int) -> DataFrame:
    """binary, pos, context (the n-1 opcodes before, <BOS> where there are none), token."""
    from ..sources.corpus import with_offset

    rows = with_offset(with_preceding(functions, max(1, n - 1)))
    pad = F.array_repeat(F.lit("<BOS>"), F.greatest(F.lit(0), F.lit(n - 1) - F.size(F.coalesce("preceding", F.array().cast("array<string>")))))
    before = F.slice(F.concat(pad, F.coalesce("preceding", F.array().cast("array<string>"))), -(n - 1), n - 1) if n > 1 else F.array().cast("array<string>")
    rows = rows.select("binary", "offset", "ops", F.concat(before, "ops").alias("line"))
    each = F.transform("ops", lambda x, i: F.struct((F.col("offset") + i).alias("pos"), F.array_join(F.slice("line", i + 1, n - 1), " ").alias("context") if n > 1 else F.lit("").alias("context"), x.alias("token")))
    return rows.select("binary", F.inline(each))


def language_model(functions: DataFrame, n: int, k: float = 1.0, share: float = 0.8) -> DataFrame:
    """binary, tokens, bits: the code length of each binary's last fifth under the smoothed model of all first four fifths.

    The rows to score are counted by (binary, context, token) first, so the joins with the model's counts move groups, not tokens.
    """
    rows = contexts(functions, n)
    sizes = functions.groupBy("binary").agg(F.floor(F.sum(F.size("ops")) * share).alias("cut"))
    counted = rows.join(sizes, "binary").groupBy("binary", "context", "token", (F.col("pos") < F.col("cut")).alias("train")).agg(F.count("*").alias("n"))
    train = counted.where("train").groupBy("context", "token").agg(F.sum("n").alias("c"))
    before = train.groupBy("context").agg(F.sum("c").alias("ctx"))
    size = train.agg(F.countDistinct("token").cast("double").alias("v"))
    scored = counted.where("not train").join(train, ["context", "token"], "left").join(before, "context", "left").crossJoin(F.broadcast(size))
    p = (F.coalesce("c", F.lit(0)) + k) / (F.coalesce("ctx", F.lit(0)) + k * F.col("v"))
    return scored.groupBy("binary").agg(F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.log2(p)).alias("bits"))
