import random
import time

import numpy as np
import pyarrow as pa
import xxhash
from conftest import ODD, WORDS, prose

from tokenloom.llm import decontaminate, licenses, quality_model

BENCHMARK = [(1, "what is the tallest hill of the old county where sheep are kept in winter"), (2, " ".join(f"item{i} word{i}" for i in range(45))), (3, None), (4, ""), (5, "who wrote the long poem of the sea? Answer: quentin marlow")]


def test_contamination(spark, folder):
    rng = random.Random(8)
    clean = [(i, prose(rng, rng.randrange(20, 300))) for i in range(60)]
    swapped = BENCHMARK[1][1].split()
    swapped[10] = swapped[40] = "other"
    planted = [
        (100, prose(rng, 50) + " " + BENCHMARK[0][1] + " " + prose(rng, 70)), (101, BENCHMARK[1][1]), (102, prose(rng, 33) + " " + " ".join(swapped) + " " + prose(rng, 10)),
        (103, prose(rng, 12) + " Who wrote the long poem, of the sea? answer: Quentin Marlow " + prose(rng, 5)), (104, prose(rng, 12) + " who wrote the long poem of the sea? answer: someone else " + prose(rng, 5)),
    ]
    found = decontaminate.op7(spark, folder(clean + planted + ODD, BENCHMARK)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(100, 1), (101, 2), (102, 2), (103, 5)}


def test_contamination_of_nothing(spark, folder, table_of):
    path = folder([], [])
    assert decontaminate.op7(spark, path).count() == 0
    docs = table_of(ODD)
    out = decontaminate.stage(spark, docs, path)
    assert out.columns == docs.columns and out.count() == len(ODD)


def test_the_stage_judges_each_row_by_itself(spark, tmp_path):
    """Null and repeated ids, and columns that have the operator's names."""
    item = "the planted item of the benchmark has these words and no others do at all"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "clean words"), (None, item), (7, "other clean words"), (7, item), (7, item), (8, None), (8, "last")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, `__key` string, `__sum` string, key string, `__found` string")
    out = decontaminate.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "clean words"), (7, "other clean words"), (8, ""), (8, "last")]


def corpus_of_topics(rng, n):
    """Texts whose words keep company by topic."""
    topics = [[f"{a}{b}" for b in range(150)] for a in "alpha beta gamma delta epsilon zeta eta theta".split()]
    common = [f"c{i}" for i in range(60)]
    draw = lambda t, k: [rng.choice(common) if rng.random() < 0.3 else rng.choice(topics[t]) for _ in range(k)]
    return topics, draw, [(i, " ".join(draw(i % len(topics), rng.randrange(60, 300)))) for i in range(n)]


def brute_contamination(rows, items):
    """All passages of all texts against all items, by the checks alone."""
    numbers = lambda t: decontaminate.numbers_of(pa.array([t], pa.string()))[0].tolist()
    texts = [(i, numbers(t)) for i, t in rows]
    counts, passages = {}, 0
    for _, words in texts:
        for a in range(0, len(words), decontaminate.PASSAGE):
            passages += 1
            for term in {w % decontaminate.TERMS for w in words[a : a + decontaminate.PASSAGE]}:
                counts[term] = counts.get(term, 0) + 1
    stop = max(decontaminate.STOP_SHARE * passages, 10)
    weight = lambda w: 0.0 if counts.get(w % decontaminate.TERMS, 0) > stop else float(np.log((1 + passages) / (1 + counts.get(w % decontaminate.TERMS, 0))) + 1)
    found = set()
    for number, text in items:
        item = numbers(text)
        for i, words in texts:
            for at in range(0, len(words), decontaminate.STEP):
                near = words[max(0, at - len(item)) : at + decontaminate.PASSAGE + len(item)]
                table = np.zeros((len(item) + 1, len(near) + 1), int)
                if len(set(item) & set(near)) < len(set(item)) / 4:
                    continue
                for x, a in enumerate(item):
                    for y, b in enumerate(near):
                        table[x + 1, y + 1] = table[x, y] + 1 if a == b else max(table[x, y + 1], table[x + 1, y])
                if table[-1, -1] >= decontaminate.LCS_SHARE * len(item) and sum(map(weight, set(item) & set(near))) >= decontaminate.COVERAGE * sum(map(weight, set(item))):
                    found.add((i, number))
                    break
    return found


def test_paraphrases_are_found_and_nothing_else(spark, folder):
    """20 to 40 % of an item's words replaced by words that keep company with them: against all pairs, and by share found."""
    rng = random.Random(5)
    topics, draw, rows = corpus_of_topics(rng, 300)
    items = [(k, " ".join(draw(k % len(topics), rng.randrange(16, 60)))) for k in range(24)]
    planted = []
    for k, text in items:
        for r, share in enumerate((0.2, 0.3, 0.4)):
            words = text.split()
            for at in rng.sample(range(len(words)), round(share * len(words))):
                words[at] = rng.choice(topics[k % len(topics)])
            host = draw((k + 3) % len(topics), rng.randrange(0, 90))
            at = rng.randrange(len(host) + 1)
            planted.append((10_000 + 10 * k + r, " ".join(host[:at] + words + host[at:])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.op7(spark, folder(rows + planted, items)).collect()}
    brute = brute_contamination(rows + planted, items)
    assert found <= brute and len(found) >= 0.99 * len(brute)
    assert len({(i, k) for i, k in found if i >= 10_000 and (i - 10_000) // 10 == k}) >= 0.9 * len(planted)


def test_many_items_go_in_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    rng = random.Random(1)
    items = [(i, prose(rng, 25)) for i in range(5)]
    found = decontaminate.op7(spark, folder([(i, prose(rng, 20) + " " + t + " " + prose(rng, 40)) for i, t in items], items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(5)}


def test_sums_of_vectors_are_right_and_cheap():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3000, 64)).astype(np.float32)
    sizes = np.concatenate([rng.integers(1, 34, 10000), [2000, 33, 1]])
    cells, ids = np.repeat(np.cumsum(rng.integers(1, 3, len(sizes))), sizes), rng.integers(0, 3000, sizes.sum())
    plain = lambda: np.add.reduceat(vectors[ids], np.flatnonzero(np.diff(cells, prepend=-1)), axis=0)

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    found, sums = decontaminate._sums(vectors, ids, cells)
    assert found.tolist() == np.unique(cells).tolist() and np.allclose(sums, plain(), atol=1e-3)
    assert least(lambda: decontaminate._sums(vectors, ids, cells)) < 0.7 * least(plain)
    empty = decontaminate._sums(vectors, ids[:0], cells[:0])
    assert len(empty[0]) == 0 and empty[1].shape == (0, 64)


def test_sums_are_as_cheap_for_vectors_that_lie_by_columns():
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((decontaminate.TERMS, 64)).astype(np.float32)
    columns = rows[:, np.ones(64, bool)]
    cells, ids = np.repeat(np.arange(20000), 14), rng.integers(0, len(rows), 280000)
    took = []
    for vectors in (rows, columns):
        began = time.process_time()
        sums = decontaminate._sums(vectors, ids, cells)[1]
        took.append(time.process_time() - began)
    assert not columns.flags.c_contiguous and np.array_equal(sums, decontaminate._sums(rows, ids, cells)[1])
    assert took[1] < 4 * took[0]


def test_first_checks_side_by_side_lose_none():
    rng = random.Random(6)
    words = [[rng.randrange(1, 40000) for _ in range(rng.randrange(1, 70))] for _ in range(12)]
    words[3][1:4], words[4] = [words[3][0] + decontaminate.TERMS] * 3, [7] * 9  # two words of one term; a word alone
    weight = np.linspace(0, 9, decontaminate.TERMS, dtype=np.float32)
    items = [decontaminate.Item(i, np.array(w, np.uint32), np.zeros(0, np.uint32), weight) for i, w in enumerate(words)]
    rows = []
    for w in words * 3:
        kept = [x for x in w if rng.random() < rng.choice((0.4, 0.6, 1))]
        rows.append(np.array([rng.randrange(1, 40000) for _ in range(rng.randrange(60))] + kept + [rng.randrange(1, 40000)] * rng.randrange(1, 40), np.uint32))
    texts, _, cells, firsts = decontaminate._gathered(pa.array([x.tobytes() for x in rows], pa.binary()), decontaminate.STEP, weight)
    near, owners = (x.ravel() for x in np.meshgrid(np.unique(cells), np.arange(len(items))))
    begins, terms = np.cumsum([0, *map(len, texts)]), decontaminate.terms_of(np.concatenate(texts))
    some = decontaminate._promising(terms, begins, firsts, near, owners, items)
    text = np.searchsorted(firsts, near, side="right") - 1
    held = np.array([items[i].held(decontaminate.window(texts[t], c - firsts[t], items[i].n)) > 0 for c, t, i in zip(near, text, owners, strict=True)])
    assert held.sum() > 30 and some[held].all() and some.sum() < 0.3 * len(some)


def test_numbers_are_hashes_and_cheap():
    rng = random.Random(4)
    words = ["", "a" * 15, "b" * 16, "c" * 40, *("".join(rng.choices("abcdeé日9", k=rng.randrange(20))) for _ in range(50000))]
    plain = lambda: [xxhash.xxh32_intdigest(w.encode()) % (2**32 - 1) + 1 if w else 0 for w in column.to_pylist()]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    for column in (pa.array(words[:0], pa.string()), pa.array(words).slice(3, 500), pa.array(words, pa.large_string()), pa.array(words)):
        assert decontaminate._numbers(column).tolist() == plain()
    text = pa.array([" ".join(words)])
    held = decontaminate.numbers_of(text)[0]
    assert held.tolist() == [n for n in plain() if n]
    assert least(lambda: decontaminate.numbers_of(text)) < least(plain)


def test_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.lcs_length(masks, len(a), b) == table[-1, -1]


def test_licences(spark, folder):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40) + "\n" + prose(rng, 15)) for i in range(40)]
    rows += [
        (100, "some text\nReleased under the MIT License.\nmore text"), (101, "Licensed under the Apache License, Version 2.0."), (102, "x\n\nThis work is licensed under the GNU General Public License, version 3."),
        (103, "Licensed under CC BY-NC 4.0."), (104, "the driver had a license and the general public was free to use the road, version or not"), (105, "the file is in the list of files"),
        (106, "Portions are released under the MIT license, see the file for details"),
    ] + ODD
    found = {(r.doc_id, r.paragraph, r.family) for r in licenses.op4(spark, folder(rows)).collect()}
    assert found >= {(100, 1, "MIT"), (101, 0, "Apache-2.0"), (102, 2, "GPL"), (103, 0, "CC-BY-NC")}
    assert {x[0] for x in found} <= {100, 101, 102, 103, 106}


def test_licences_held_out(spark, folder):
    """A wording that training does not see is still given to its family, or to none, and the corpus's own lines to none."""
    rng = random.Random(17)
    corpus = [prose(rng, 25) for _ in range(400)]
    texts, labels, made_from = licenses._training_texts(corpus[:300])
    held = licenses.held_out(labels, made_from)
    assert not {t for t, h in zip(made_from, held, strict=True) if h and t >= 0} & {t for t, h in zip(made_from, held, strict=True) if not h and t >= 0}
    model = licenses.fit_texts(spark, *([x for x, h in zip(rows, held, strict=True) if not h] for rows in (texts, labels, made_from)))
    tried = [(i, x, k) for i, (x, k, h) in enumerate(zip(texts, labels, held, strict=True)) if h and k < len(licenses.FAMILIES) - 1]
    docs = spark.createDataFrame([(i, x) for i, x, _ in tried] + [(100_000 + i, x) for i, x in enumerate(corpus[300:])], "doc_id long, text string")
    said = {r.doc_id: r.family for r in licenses.scan(docs, model).collect()}
    right = sum(said.get(i) == licenses.FAMILIES[k] for i, _, k in tried)
    wrong = sum(said.get(i, licenses.FAMILIES[k]) != licenses.FAMILIES[k] for i, _, k in tried)
    assert not any(i >= 100_000 for i in said)
    assert right >= 0.5 * len(tried) and wrong <= 0.2 * len(tried), (right, wrong, len(tried))


def test_licences_of_nothing(spark, folder):
    assert licenses.op4(spark, folder([])).count() == 0


def test_no_python_in_the_licence_scan(spark, table_of):
    docs = table_of([(1, "Released under the MIT License.")])
    plan = licenses.scan(docs, licenses.train(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(1)
    n, accuracy = 20_000, [0.9, 0.8, 0.7, 0.95]
    truth = rng.random(n) < 0.7
    patterns = {}
    for y in truth:
        p = "".join("0" if rng.random() < 0.1 else "+" if (rng.random() < a) == y else "-" for a in accuracy)
        patterns[p] = patterns.get(p, 0) + 1
    share, table, posterior = quality_model.fit_accuracies(patterns)
    assert abs(share - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        assert abs(table[j, 1, 1] / (table[j, 1, 1] + table[j, 1, 2]) - a) < 0.03
    assert posterior["++++"] > 0.99 > 0.01 > posterior["----"]


def junk(rng):
    return rng.choice([lambda: " ".join([rng.choice(WORDS)] * 80), lambda: " ".join(w.upper() + "!!" for w in prose(rng, 80).split()), lambda: " | ".join(prose(rng, 60).split()), lambda: " ".join(w + rng.choice(["***", "%%%", "###"]) for w in prose(rng, 60).split())])()


def test_quality_model(spark, folder):
    rng = random.Random(11)
    rows = [(1000 + i, prose(rng, rng.randrange(30, 300)) if i % 4 else junk(rng)) for i in range(400)] + ODD
    found = quality_model.op10(spark, folder(rows)).collect()
    assert len(found) == len(rows)
    kept = {r.doc_id: r.kept for r in found}
    assert sum(kept[1000 + i] == (i % 4 > 0) for i in range(400)) > 390
    assert not kept[1] and not kept[2] and not kept[3]


def test_quality_model_of_nothing(spark, folder):
    assert quality_model.op10(spark, folder([])).count() == 0
