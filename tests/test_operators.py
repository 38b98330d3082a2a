import lzma
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import clones, frequency, information, kernels, sampling, similarity, structure
from tokenloom.sources import corpus, objdump, sinks

TINY = [("binary1", None, 0, "mov add cmp jl ret".split()), ("binary2", None, 0, "push mov mov pop ret".split()), ("binary3", None, 0, "mov call mov ret".split())]
SCHEMA = "binary string, category string, func long, ops array<string>"


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(1)
    rows = []
    for b in "xyz":
        for f in range(12):
            rows.append((b, b, f, [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 30]))]))
    return spark.createDataFrame(rows, SCHEMA), rows


def whole(rows):
    out = {}
    for b, _, _, ops in sorted(rows, key=lambda r: (r[0], r[2])):
        out.setdefault(b, []).extend(ops)
    return out


def test_tiny_corpus(tiny):
    rates = {r.n: r for r in frequency.entropy_rates(frequency.ngram_counts(tiny, range(1, 6), ())).collect()}
    assert math.isclose(rates[1].entropy, 2.6385, abs_tol=1e-4) and math.isclose(rates[2].entropy, math.log2(11)) and math.isclose(rates[2].conditional_entropy, 0.8210, abs_tol=1e-4)
    assert [rates[n].total_ngrams for n in range(1, 6)] == [14, 11, 8, 5, 2]
    assert [(r.opcode, r.id) for r in corpus.vocabulary(corpus.token_rows(tiny)).orderBy("id").collect()] == list(zip("add call cmp jl mov pop push ret".split(), range(8), strict=True))
    assert structure.motifs(tiny, 4).count() == structure.positional(tiny).count() == clones.shingled(tiny, 3).count() == 0


def test_ngrams_run_on_across_functions(some):
    df, rows = some
    expected = Counter()
    for b, seq in whole(rows).items():
        for n in range(1, 6):
            expected.update((b, n, " ".join(seq[i : i + n])) for i in range(len(seq) - n + 1))
    assert {(r.binary, r.n, r.ngram): r["count"] for r in frequency.ngram_counts(df, range(1, 6)).collect()} == expected


def test_positions_prefixes_contexts(some):
    df, rows = some
    seqs = whole(rows)
    assert {(r.binary, r.pos): r.opcode for r in corpus.positions(df).collect()} == {(b, i): x for b, s in seqs.items() for i, x in enumerate(s)}
    assert {r.binary: r.ops for r in corpus.prefixes(df, 17).collect()} == {b: s[:17] for b, s in seqs.items()}
    for n in (1, 2, 4):
        expected = {(b, i): (" ".join((["<BOS>"] * (n - 1) + s)[i : i + n - 1]), x) for b, s in seqs.items() for i, x in enumerate(s)}
        assert {(r.binary, r.pos): (r.context, r.token) for r in structure.contexts(df, n).collect()} == expected


def test_no_function_is_lost_or_doubled(spark):
    """Functions without an id, with one id, equal ones, and one of a null binary; ids that lie in several spans."""
    rows = [("x", None, None, ["n"]), ("x", None, 1, ["a", "b"]), ("x", None, 1, ["a", "b"]), ("x", None, 1, ["c"]), ("x", None, 9000, ["d"] * 3), ("x", None, 9001, ["e"]), ("x", None, 40000, ["f"]), (None, None, 5, ["g", "h"]), ("y", None, None, ["i"]), ("y", None, None, ["i"])]
    df = spark.createDataFrame(rows, SCHEMA)
    for got in (corpus.with_offset(df), corpus.with_following(df, 3), corpus.with_preceding(df, 3)):
        assert Counter((r.binary, r.func, tuple(r.ops)) for r in got.collect()) == Counter((b, f, tuple(o)) for b, _, f, o in rows)
    assert sorted((r.binary or "", r.pos) for r in corpus.positions(df).select("binary", "pos").collect()) == sorted([("x", i) for i in range(11)] + [("", 0), ("", 1), ("y", 0), ("y", 1)])
    followed = {(r.func, tuple(r.ops)): r.following for r in corpus.with_following(df, 3).where("binary = 'x' and func > 1").collect()}
    assert followed == {(9000, ("d",) * 3): ["e", "f"], (9001, ("e",)): ["f"], (40000, ("f",)): []}
    counts = {(r.binary, r.n): r.t for r in frequency.ngram_counts(df, [1, 2, 3]).groupBy("binary", "n").agg(F.sum("count").alias("t")).collect()}
    assert counts == {("x", 1): 11, ("x", 2): 10, ("x", 3): 9, (None, 1): 2, (None, 2): 1, ("y", 1): 2, ("y", 2): 1}
    hashed = {(r.binary, r.n, r["count"]): r.c for r in frequency.ngram_frequencies(df, [1, 2, 3]).groupBy("binary", "n", "count").agg(F.count("*").alias("c")).collect()}
    named = {(r.binary, r.n, r["count"]): r.c for r in frequency.ngram_counts(df, [1, 2, 3]).groupBy("binary", "n", "count").agg(F.count("*").alias("c")).collect()}
    assert hashed == named


def test_mutual_information(some):
    df, rows = some
    for r in information.mutual_information(df, 7).collect():
        s = whole(rows)[r.binary]
        pairs = Counter(zip(s, s[r.lag :], strict=False))
        n = sum(pairs.values())
        x, y = Counter(s[: n]), Counter(s[r.lag :])
        assert math.isclose(r.mi, sum(c / n * math.log2(c * n / (x[a] * y[b])) for (a, b), c in pairs.items()), abs_tol=1e-9)


def test_sliding_windows(some):
    df, rows = some
    for w in (16, 32):
        expected = {}
        for b, s in whole(rows).items():
            for start in range(0, len(s) - w + 1, w // 4):
                c = Counter(s[start : start + w])
                expected[b, start] = -sum(k / w * math.log2(k / w) for k in c.values())
        got = {(r.binary, r.start): r.entropy for r in information.sliding_entropy(corpus.positions(df), w).collect()}
        assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got)


def test_annotation_rules(spark):
    cases = {
        "push mov": "Function prologue — stack frame setup", "push pop": "Function prologue — save register", "leave ret": "Function epilogue — leave/ret", "pop ret": "Function epilogue — pop/ret",
        "mov ret": "Function epilogue — return", "cmp je": "Loop/branch — compare and jump", "test jne": "Loop/branch — test and jump", "mov xor": "Register zeroing — xor idiom",
        "mov call": "Function call — subroutine invocation", "mov mov mov": "Data movement — bulk register/memory transfers", "lea mov": "Memory access — address calculation and load",
        "add nop": "Arithmetic — integer operations", "nop push push": "Stack — multiple pushes", "nop pop pop": "Stack — multiple pops", "nop nop": "Generic pattern",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "m string").select("m", structure.annotate(F.split("m", " ")).alias("a"))
    assert {r.m: r.a for r in rows.collect()} == cases


def test_phrases_and_packing():
    assert kernels.lz78("mov add cmp jl ret".split()) == 5 and kernels.lz78("push mov mov pop ret".split()) == 4 and kernels.lz78([]) == 0
    assert kernels.pack_ids(np.array([1, 255])) == b"\x01\xff" and kernels.pack_ids(np.array([1, 256])) == b"\x01\x00\x00\x01"
    with pytest.raises(ValueError, match="no compressor"):
        kernels.compressor("brotli")


def test_compression_and_ncd(some):
    df, rows = some
    seqs, ids = whole(rows), dict(zip("abcd", range(4), strict=True))
    coded = kernels.encoded(df, corpus.vocabulary(corpus.token_rows(df)), 1000)
    data = {b: bytes(ids[x] for x in s) for b, s in seqs.items()}
    for r in kernels.compression(coded).collect():
        assert (r.zlib_compressed_size, r.lzma_compressed_size, r.original_size) == (len(zlib.compress(data[r.binary])), len(lzma.compress(data[r.binary])), len(data[r.binary]))
    for r in kernels.ncd(coded, "zlib").collect():
        x, y, xy = (len(zlib.compress(v)) for v in (data[r.a], data[r.b], data[r.a] + data[r.b]))
        assert math.isclose(r.distance, min(1, max(0, (xy - min(x, y)) / max(x, y))))


def test_compression_and_samples_read_whole_binaries(spark):
    rng = random.Random(8)
    rows = [(b, b, f, [str(rng.randrange(wide)) for _ in range(3000)]) for b, wide in (("x", 200), ("y", 400)) for f in range(41)]
    df, seqs = spark.createDataFrame(rows, SCHEMA).repartition(5), whole(rows)
    words = corpus.vocabulary(corpus.token_rows(df))
    ids = {r.opcode: r.id for r in words.collect()}
    data = {b: kernels.pack_ids(np.array([ids[x] for x in s])) for b, s in seqs.items()}
    found = {r.binary: r for r in kernels.compression(kernels.chunks(df, words)).collect()}
    mixed = {r.binary: r for r in kernels.compression(kernels.chunks(df, words), 42).collect()}
    for b, s in seqs.items():
        r = found[b]
        assert (r.instruction_count, r.original_size, r.zlib_compressed_size, r.lzma_compressed_size) == (123_000, len(data[b]), len(zlib.compress(data[b])), len(lzma.compress(data[b])))
        assert r.lz_complexity == int(kernels.lz78(s[:100_000]) * 1.23)
        assert (mixed[b].instruction_count, mixed[b].original_size) == (123_000, len(data[b]))
    assert {r.binary: r.ids for r in kernels.sampled(df, words).collect()} == {b: [ids[x] for x in s[::2][:50_000]] for b, s in seqs.items()}


def test_queries_read_whole_binaries(spark, tmp_path):
    from tokenloom.plans import kernels as plans

    rows = [(i, " ".join("w%d" % (k * k % 977) for k in range(7000 + i)), "en", "s") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    n = 28_006
    for query in (plans.d13, plans.d16, plans.d17):
        assert [r.instruction_count for r in query(spark, str(tmp_path)).collect()] == [n]
    (r,) = plans._sampled(spark, str(tmp_path)).collect()
    assert len(r.ids) == n


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(15))] for _ in range(2))
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert clones.align(np.array(a), np.array(b)) == h.max()
        core = clones.common_core(a, b)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert len(core) == table[-1, -1]


def test_bands():
    assert clones.band_shape(0.7) == (14, 9) and clones.band_shape(0.9) == (5, 25)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 8), (8, 6)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in clones.components(spark.createDataFrame(edges, "id1 long, id2 long")).collect()}
    assert {got[i] for i in (1, 2, 3, 9)} == {1} and {got[i] for i in (5, 6, 7, 8)} == {5} and {got[i] for i in range(100, 131)} == {100}


def test_families(spark):
    a, b = "a b c d e f g h i j k l".split(), "a b c d e f x h i j k l".split()
    functions = spark.createDataFrame([("x", None, 1, a), ("y", None, 2, a), ("y", None, 3, b)], SCHEMA)
    pairs = spark.createDataFrame([(1, 2, 1.0, 1.0), (1, 3, 0.6, 0.85)], "id1 long, id2 long, jaccard double, alignment double").withColumn("clone_type", clones.clone_type(F.col("jaccard"), F.col("alignment")))
    assert [r.clone_type for r in pairs.orderBy("id2").collect()] == [1, 3]
    (f,) = clones.families(pairs, clones.components(pairs), functions).collect()
    assert f.members == [1, 2, 3] and f.is_cross_binary and f.conserved_core == [x for x in a if x != "g"] and math.isclose(f.divergence_score, 1 / 12)


def test_cores_are_of_whole_sequences(spark):
    """Ties go up, as in the whole table; what follows the first 200 opcodes counts."""
    rng = random.Random(11)

    def plain(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        out, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.append(a[i - 1])
                i, j = i - 1, j - 1
            elif table[i - 1, j] >= table[i, j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    for n in range(300):
        a = [f"w{rng.randrange(1 + n % 7)}" for _ in range(rng.randrange(40))]
        b = [x for x in a if rng.random() < 0.8] + a[: n % 5] if n % 2 else [f"w{rng.randrange(1 + n % 7)}" for _ in range(rng.randrange(40))]
        assert clones.common_core(a, b) == plain(a, b)
    texts = [[f"w{rng.randrange(500)}" for _ in range(450)]]
    texts += [[x if i < 200 or rng.random() < 0.9 else "x" for i, x in enumerate(texts[0])] for _ in range(3)]
    functions = spark.createDataFrame([("x", None, i, t) for i, t in enumerate([*texts, texts[1]])], SCHEMA)
    pairs = spark.createDataFrame([(0, i, 1) for i in range(1, 5)], "id1 long, id2 long, clone_type int")
    (f,) = clones.families(pairs, clones.components(pairs), functions).collect()
    core = texts[0]
    for t in texts[1:]:
        core = plain(core, t)
    assert f.size == 5 and f.conserved_core == core and len(core) > 200 and math.isclose(f.divergence_score, 1 - len(core) / 450)


def test_mann_whitney(spark):
    rng = random.Random(4)
    rows = [(round(rng.gauss(0 if w else 0.5, 1), 1), w) for w in [True] * 15 + [False] * 40]
    (r,) = similarity.mann_whitney(spark.createDataFrame(rows, "distance double, within boolean")).collect()
    u = sum((x > y) + 0.5 * (x == y) for x, w in rows if w for y, v in rows if not v)
    assert math.isclose(r.u, u) and math.isclose(r.effect_r, 1 - 2 * u / 600) and 0 < similarity.p_less(r.z) < 1


def test_linkage_and_cut():
    points = np.array([0, 0.1, 0.2, 5, 5.1, 9])
    m = np.abs(points[:, None] - points[None])
    for method in ("complete", "average", "single"):
        merges = kernels.linkage(m, method)
        assert kernels.cut(merges, 6, 0.5) == [1, 1, 1, 2, 2, 3] and len(merges) == 5 and kernels.cophenetic(m, merges) > 0.8
    assert [round(x[2], 6) for x in kernels.linkage(m, "complete")] == [0.1, 0.1, 0.2, 4.0, 9.0]


def test_spectrum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 50))
    d95, ratio, share = kernels.spectrum(x)
    assert d95 <= 3 and 1 <= ratio <= 3.01 and math.isclose(share.sum(), 1)
    assert np.allclose(np.abs(kernels.embed(x, 2)), np.abs(kernels.embed(x[:, ::-1], 2)))


def test_zipf_fits():
    rank = np.arange(1, 2001, dtype=float)
    count = np.round(1e6 * rank**-1.3)
    assert abs(frequency.zipf_mle(2000, count.sum(), float(count @ np.log(rank))) - 1.3) < 0.01
    low, high = frequency.ols_bootstrap(rank, count)
    assert low <= 1.31 and high >= 1.29 and frequency.ols_bootstrap(rank[:3], count[:3]) == (0.0, 0.0)


def test_bootstraps_read_all_ranks(spark, tmp_path):
    from tokenloom.plans import extras
    from tokenloom.plans import frequency as plans

    n = 60_000
    rows = [(i, " ".join("w%d" % k for k in range(i * 600, (i + 1) * 600)) + " w0 w1 w2 w0" * 3, "en", "s") for i in range(n // 600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = extras.e02(spark, str(tmp_path)).collect()
    assert r.points == n and r.ci_low <= r.ci_high
    (r,) = plans.e03(spark, str(tmp_path)).collect()
    low, high = frequency.zipf_bootstrap(n, r.total, r.alpha, rounds=60)
    assert r.vocabulary == n and abs(r.ci_low - low) < 0.003 and abs(r.ci_high - high) < 0.003
    rank = np.arange(1, 3001, dtype=float)
    count = np.round(1e6 * rank**-1.3 * np.exp(np.random.default_rng(1).normal(0, 0.3, 3000)) + 1)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(rank, count, strict=True)], "rank long, count long")
    assert np.allclose(frequency.ols_bootstrap_rounds(df)[:2], frequency.ols_bootstrap(rank, count), atol=0.01)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {(r.q, r.r): r.neighbour for r in information.nearest(df, df.where("vec_id % 50 = 0"), 3, block=4).collect()}
    for q in range(0, 300, 50):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(d)[:3].tolist()


def test_samples(spark):
    rows = spark.createDataFrame([("b", 0, i, str(i)) for i in range(250)], "binary string, func long, pos long, opcode string")
    assert [r.pos for r in sampling.stride_sample(rows, 100).orderBy("pos").collect()] == list(range(0, 200, 2))
    assert sampling.weighted_sample(sampling.importance(rows), 10).count() == 10


def test_listing(spark):
    text = ["garbage", "  10: 55 \tpush rax", "0000000000001000 <main@plt>:", "    1000:\t55                   \tpush   rbp", "    1001:\t48 89 e5             \tMOV.w    rbp,rsp", "", "    1008:\t00 00 ", "0000000000002000 <empty>:", "0000000000003000 <f>:", "    3000:\tc3                   \tret"]
    rows = objdump.parse_listing(spark.createDataFrame([("a", i, x) for i, x in enumerate(text)], "file string, line_no int, value string")).orderBy("line_no").collect()
    assert [(r.func, r.address, r.opcode, bytes(r.raw_bytes)) for r in rows] == [("main@plt", 0x1000, "push", b"\x55"), ("main@plt", 0x1001, "mov", b"\x48\x89\xe5"), ("f", 0x3000, "ret", b"\xc3")]


def test_sinks(spark, tmp_path, tiny):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.txt").write_text("mov\n\nret\n")
    assert [(r.binary, r.ops) for r in sinks.read_sequences(spark, str(tmp_path / "s")).collect()] == [("one", ["mov", "ret"])]
    sinks.write_result(tiny, str(tmp_path / "j"), "json")
    assert '"category":null' in spark.read.text(str(tmp_path / "j")).first().value
    sinks.write_result(tiny, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_stream(spark, tmp_path):
    from tokenloom.streaming.frequency import run_once, windowed_frequency

    rows = [(f"2024-01-{d:02d} 10:00:00", "abc"[d % 3]) for d in range(1, 20) for _ in range(3)]
    df = spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    df.write.parquet(str(tmp_path / "in"))
    got = run_once(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = {tuple(r) for r in windowed_frequency(df).collect()}
    closed = {tuple(r) for r in got.collect()}
    assert closed <= batch and len(closed) >= 15
