import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, WORDS, prose

from tokenloom.llm import line_dedup, near_dedup


def shingles(text):
    words = near_dedup.words_of(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    """(id, text) to the smallest id of the class: all pairs."""
    texts = {}
    for i, t in sorted(rows):
        texts.setdefault(tuple(near_dedup.words_of(t)), i)
    sets = {i: shingles(" ".join(w)) for w, i in texts.items()}
    df, n = Counter(g for s in sets.values() for g in s), len(sets)
    weight = {i: {g: c * (1 + near_dedup.DAMPING * math.log((1 + n) / (1 + df[g])) / math.log(1 + n)) for g, c in s.items()} for i, s in sets.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                least = sum(min(x, weight[b].get(g, 0)) for g, x in weight[a].items())
                if least and least / (sum(weight[a].values()) + sum(weight[b].values()) - least) >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return [(i, root(texts[tuple(near_dedup.words_of(t))])) for i, t in rows]


def test_classes_are_those_of_all_pairs(spark, table_of, texts):
    found = near_dedup.classes(table_of(texts)).select("key", "class_first.key").collect()
    assert sorted((r[0], r[1]) for r in found) == sorted(brute_classes(texts))


def test_large_group_of_near_copies(spark, table_of):
    import random

    rng = random.Random(9)
    first = prose(rng, 150).split()
    rows = []
    for i in range(150):
        copy = list(first)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS) + str(rng.randrange(50))
        rows.append((i, " ".join(copy[: len(copy) - rng.choice([0, 0, 10, 25])])))
    found = near_dedup.classes(table_of(rows)).select("key", "class_first.key").collect()
    assert sorted((r[0], r[1]) for r in found) == sorted(brute_classes(rows))


def test_odd_rows(spark, folder):
    rows = near_dedup.op1(spark, folder(ODD)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == {None}  # all are copies of the text without words whose id is null
    assert len(by[5]) == 1 and by[4] == {4}


def test_empty(spark, folder):
    path = folder([])
    assert near_dedup.op1(spark, path).count() == 0 and line_dedup.op8(spark, path).count() == 0


def test_stage_keeps_one_of_each_class(spark, table_of, texts):
    docs = table_of(texts)
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in brute_classes(texts)})


def test_sampling_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(1)
    value = np.arange(400, dtype=np.uint64) * np.uint64(7919)
    wa, wb = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    wa[:80], wb[80:160] = 0.01, 0.01
    alone = np.array([20.0])
    same, bands = 0, 600
    a, b = (near_dedup.sample_bands(np.array([i], np.uint64), np.array([0]), value, w, alone, bands, 1) for i, w in ((1, wa), (2, wb)))
    same = sum(int(x[0] == y[0] and x[0] != 0) for x, y in zip(a, b, strict=True))
    least = np.minimum(wa, wb).sum()
    assert abs(same / bands - least / (wa.sum() + wb.sum() + 40 - least)) < 0.06


def test_difference_prefixes_meet_where_partners_are(spark):
    """Of random members around a pivot, no similar pair with a member off the pivot is missed."""
    rng = np.random.default_rng(5)
    size, met = 120, []
    pivot = (float(size), np.arange(size, dtype=np.uint64), np.ones(size), np.full(size, 30.0))
    members = []
    for _ in range(120):
        kept = np.flatnonzero(rng.random(size) > rng.choice([0.05, 0.15, 0.25]))
        extra = np.unique(rng.integers(200, 200 + rng.choice([10, 40]), rng.integers(0, 30)))
        hashes = np.concatenate((kept, extra)).astype(np.uint64)
        alone = float(rng.integers(0, 10))
        members.append((len(hashes) + alone, hashes, np.ones(len(hashes)), np.where(hashes < size, 30.0, 3.0)))
    told = [near_dedup.compare(pivot, m) for m in members]
    for i, x in enumerate(members):
        for j in range(i):
            y = members[j]
            least = len(np.intersect1d(x[1], y[1]))
            if least / (x[0] + y[0] - least) >= 0.8 and not (told[i][0] and told[j][0]):
                met.append((i, j))
    shared = [(i, j, a["left"], b["left"]) for i in range(len(told)) for j in range(i) for a in told[i][-1] for b in told[j][-1] if a["element"] == b["element"]]
    schema = ", ".join(f"{of} struct<i:int,size:double,added:double,common:double,lacking:double,left:double>" for of in "xy")
    rows = spark.createDataFrame([((i, *told[i][1:5], a), (j, *told[j][1:5], b)) for i, j, a, b in shared], schema)
    kept = {(r.i, r.j) for r in rows.where(near_dedup.partners("x", "y")).selectExpr("x.i as i", "y.i as j").distinct().collect()}
    assert met and kept >= set(met) and len(kept) < len({(i, j) for i, j, _, _ in shared})


def brute_lines(rows):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_dedup.line_key(line)) >= 40:
                docs[line_dedup.line_key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[line_dedup.line_key(x)]) < 5 or max(docs[line_dedup.line_key(x)], key=lambda d: -1 if d is None else d) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_lines(spark, folder, parts):
    long = [f"this line number {k} is long enough to count as a line of its own" for k in range(6)]
    rows = [(i, "\n".join(["short", *(("  " + x.upper() + "\t") if i % 2 else x for k, x in enumerate(long) if i % (k + 1) == 0), f"own line of document {i}", long[0]])) for i in range(60)]
    rows += ODD
    path = folder(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [tuple(r) for r in line_dedup.op8(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(brute_lines(rows), key=key)


def test_line_stage(spark, table_of):
    docs = table_of([(i, "a line that all of these documents hold, word for word\nown %d" % i) for i in range(6)])
    out = line_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: "own %d" % i if i < 5 else "a line that all of these documents hold, word for word\nown 5" for i in range(6)}
    assert all(r.n_chars == len(r.text) for r in out.collect())
