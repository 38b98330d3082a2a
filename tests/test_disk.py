"""What queries over whole sequences shuffle, against the text they read; and that they find the same."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import clones, frequency, ngram_blocks, structure

SCHEMA = "binary string, category string, func long, ops array<string>"


def moved(spark, run):
    """Bytes shuffled while run() runs, and what it gives. Nothing is broadcast for its size: at size nothing is."""
    total = lambda: (lambda x: sum(x.apply(i).totalShuffleWrite() for i in range(x.size())))(spark.sparkContext._jsc.sc().statusStore().executorList(True))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, out = total(), run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before, out


@pytest.fixture(scope="module")
def corpus(spark):
    """Functions that share no shingle, and near and exact copies of a few."""
    rng, rows = random.Random(5), []
    for f in range(300):
        rows.append([f"w{rng.randrange(20000)}" for _ in range(400)])
    for f in range(30):
        copy = list(rows[f % 5])
        for _ in range(f % 3 * 20):
            copy[rng.randrange(len(copy))] = "x" * rng.randrange(1, 70)
        rows.append(copy)
    rows += [["a"] * 5, ["a"] * 40, ["a"] * 50]
    rng.shuffle(rows)
    text = sum(len(w) + 1 for r in rows for w in r)
    return spark.createDataFrame([(f"b{i % 3}", None, i, r) for i, r in enumerate(rows)], SCHEMA).repartition(4).cache(), rows, text


def test_clone_pairs_move_little_and_lose_none(spark, corpus):
    functions, _, text = corpus
    want = {}
    for k in (3, 4, 5):
        sets = clones.shingled(functions, k)
        signed = clones.signatures(sets).cache()
        found = clones.candidates(signed, 0.7).union(clones.candidates(signed, 0.9)).select("id1", "id2").distinct()
        for r in clones.jaccard(found, sets).collect():
            want[r.id1, r.id2] = max(r.jaccard, want.get((r.id1, r.id2), 0.0))
    size, rows = moved(spark, lambda: clones.best_pairs(functions).collect())
    assert len(want) > 15 and {(r.id1, r.id2): r.jaccard for r in rows} == want and len(rows) == len(want)
    assert size < 2 * text


def test_alignments_move_little_and_are_those_of_pairs(spark, corpus, monkeypatch):
    functions, ops, text = corpus
    pairs = clones.best_pairs(functions).cache()
    pairs.count()
    for block in (clones.BLOCK, 2):
        monkeypatch.setattr(clones, "BLOCK", block)
        size, rows = moved(spark, lambda: clones.aligned(pairs, functions).collect())
        assert size < text or block == 2
        assert len(rows) == pairs.count()
        for r in rows[::7]:
            code = {w: i for i, w in enumerate({*ops[r.id1], *ops[r.id2]})}
            x, y = (np.array([code[w] for w in ops[i]]) for i in (r.id1, r.id2))
            assert r.alignment == min(1.0, clones.align(x, y) / (2 * min(len(x), len(y))))


def test_alignments_of_copies_move_no_sequence(spark):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(20000)}" for _ in range(400)] for _ in range(20)]
    near = [["x"] * (i % 3) + t[:390] for i, t in enumerate(texts)]
    rows = [(f"b{i % 3}", None, i, t) for i, t in enumerate(texts * 30 + near)]
    functions = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    pairs = clones.best_pairs(functions).cache()
    assert pairs.where("same").count() == 20 * 29 and pairs.where("not same").count() >= 20
    size, got = moved(spark, lambda: clones.aligned(pairs, functions).collect())
    assert size < sum(len(w) + 1 for r in rows for w in r[3]) / 5
    plain = clones.aligned(pairs.drop("same"), functions).collect()
    assert sorted(got) == sorted(plain) and len(got) == pairs.count()


def test_families_of_copies_move_few_beginnings(spark):
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(20000)}" for _ in range(200)] for _ in range(20)]
    rows = [(f"b{i % 3}", None, i, t) for i, t in enumerate(texts * 30 + [t[5:] for t in texts])]
    functions = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    pairs = spark.createDataFrame([(i % 20, i, 1) for i in range(20, len(rows))], "id1 long, id2 long, clone_type int").cache()
    parts = clones.components(pairs).cache()
    assert functions.count() == 620 and parts.count() == 620
    size, got = moved(spark, lambda: {r.family: r for r in clones.families(pairs, parts, functions).collect()})
    assert size < sum(len(w) + 1 for r in rows for w in r[3]) / 3
    for i, t in enumerate(texts):
        assert got[i].members == list(range(i, 620, 20)) and got[i].size == 31 and got[i].conserved_core == t[5:]


def test_alignments_in_a_band_are_whole(spark):
    rng, pairs = random.Random(6), []
    for i in range(300):
        a = [rng.randrange(4 if i % 2 else 2000) for _ in range(rng.randrange(300))]
        b = [x for x in a if rng.random() > i % 5 / 10] + [rng.randrange(4) for _ in range(i % 7 * 20)]
        at = rng.randrange(len(b) + 1) if i % 3 == 0 else 0
        pairs.append((np.array(a, np.int32), np.array(b[at:] + b[:at], np.int32)))
    assert clones.align_all(pairs).tolist() == [clones.align(a, b) for a, b in pairs]


def test_only_keeps_all_that_is_wanted(spark):
    rows = spark.range(5000).select(F.col("id").alias("func"))
    got = {r.func for r in clones.only(rows, "func", spark.range(0, 5000, 50)).collect()}
    assert got >= set(range(0, 5000, 50)) and len(got) < 120


def test_spectrum_is_that_of_the_ngrams_and_moves_little(spark, corpus):
    functions, _, text = corpus
    size, got = moved(spark, lambda: sorted(map(tuple, ngram_blocks.spectrum(functions, 5).select("binary", "n", "count", "times").collect())))
    want = frequency.ngram_counts(functions, range(1, 6)).groupBy("binary", "n", "count").agg(F.count("*").alias("times"))
    assert got == sorted(map(tuple, want.collect()))
    assert size < 6 * text


def test_top_ngrams_are_those_of_all_counts_and_move_little(spark, corpus):
    functions, _, text = corpus
    all = frequency.ngram_counts(functions, [2, 3, 4]).cache()
    for top, short in ((700, ngram_blocks.COMMON), (700, 300), (5, 0)):
        best = [(r.n, r.ngram) for n in (2, 3, 4) for r in all.where(F.col("n") == n).groupBy("n", "ngram").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "ngram").limit(top).collect()]
        size, found = moved(spark, lambda: ngram_blocks.top_ngrams(functions, (2, 3, 4), top, short))
        assert found == best
        more, got = moved(spark, lambda: sorted(map(tuple, ngram_blocks.counts_of(functions, found).select("binary", "n", "ngram", "count").collect())))
        assert got == sorted(map(tuple, all.join(spark.createDataFrame(best, "n int, ngram string"), ["n", "ngram"]).select("binary", "n", "ngram", "count").collect()))
        assert size + more < 6 * text or short < 1000


def test_motifs_in_two_passes(spark, corpus, monkeypatch):
    functions, _, text = corpus
    monkeypatch.setattr(structure, "PART", 100)
    functions = functions.coalesce(1)
    size, got = moved(spark, lambda: sorted(map(tuple, structure.best_motifs(functions, range(4, 7), 5).collect())))
    want = [tuple(r) for k in range(4, 7) for r in structure.motifs(functions, k, top=5).collect()]
    assert got == sorted(want) and len(got) == 15
    assert size < 2 * text
