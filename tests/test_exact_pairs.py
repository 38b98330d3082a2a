"""The clone graph against all pairs."""

import random

import numpy as np

from tokenloom.operators import exact_pairs
from tokenloom.plans.registry import QUERIES, load


def test_clone_graph_has_every_link(spark, tmp_path):
    """Pairs about the threshold, texts that repeat themselves, a large group of near copies, and copies."""
    rng, texts = random.Random(12), []
    for i in range(60):
        base = [f"w{rng.randrange(4 if i % 4 == 0 else 3000)}" for _ in range(rng.randrange(8, 90))]
        texts.append(base)
        for n in (rng.randrange(1, 20), rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(len(base) // n):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(1000)}"
            texts.append(copy[: rng.randrange(len(copy) // 2, len(copy) + 1)] if n % 3 == 0 else copy)
    base = [f"g{rng.randrange(3000)}" for _ in range(60)]
    texts += [[w if rng.random() < 0.97 else "x" for w in base] for _ in range(90)]
    texts += [["a"] * 12, ["a"] * 30, ["a", "b"] * 20, ["short"] * 9, []] + texts[:5] + [texts[0]] * 5
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "en", f"s{i % 3}") for i, t in enumerate(texts)] + [(None, " ".join(texts[0]), "en", "s"), (9999, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for k in (3, 4, 5)} if len(t) >= 10 else {} for t in texts]
    want, weak = {}, 0
    for x in range(len(texts)):
        for y in range(x):
            best = max((len(s & sets[y][k]) / len(s | sets[y][k]) for k, s in sets[x].items() if sets[y]), default=0)
            weak += 0.5 <= best < 0.65
            for i in (x, y) if best >= 0.5 else ():
                want[i] = want.get(i, 0) + 1
    load()
    got = QUERIES["f08_clone_graph"](spark, str(tmp_path)).collect()
    assert {r.node: r.degree for r in got} == want and len(got) == len(want) and weak > 20
    assert all(r.size == len(texts[r.node]) and r.binary == f"s{r.node % 3}/en" for r in got)


def test_packed_columns():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        columns = [rng.integers(-(2**62), 2**62, n), np.ones(n, np.int64), rng.integers(0, 70000, n)]
        assert all((x == y).all() for x, y in zip(columns, exact_pairs.unpack(exact_pairs.pack(*columns), n), strict=True))
