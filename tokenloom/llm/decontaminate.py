"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts turns words into 32-bit hashes, which are written; no later
   step reads a text. The terms of the vectors are the corpus's whole vocabulary,
   hashed to TERMS; the pass counts the passages of PASSAGE words that hold each.
2. Randomised SVD of the TF-IDF passages: each task adds A'(A R) over its passages,
   and the tasks' sums are added up as a tree. One half of R is random, the other half
   random combinations of the items, so the range has the corpus's strongest
   directions and those of the words that keep the items' words company. The left
   singular vectors of the sum, RANK of them, span the latent space.
3. Every passage, at steps of half a passage, is projected into that space, and
   compared there with every part of every item. Those with a latent cosine of COSINE
   or more are candidates; nothing else chooses them.
4. A candidate's surroundings are compared with the whole item: the longest common
   subsequence of words must hold LCS_SHARE of the item, the item's terms must be
   there to COVERAGE of their weight, and an answer that the item states must stand
   there word by word.

The benchmark is the query set. ITEMS of its items are sent to the tasks at a time, so
that has a fixed bound; texts are numbered and the space is found once for all.

Defined results: null and empty texts match nothing; items without words match
nothing; a null doc_id is reported as null; rows that repeat a doc_id give one row
an item; empty tables give an empty table. In the stage each row goes or stays by its
own id and text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh, id_of, key_of, materialise, slices, sum_of, table, tidy

PASSAGE = 32
STEP = PASSAGE // 2
TERMS = 1 << 14
RANK = 64
#: Items that are sent to the tasks at a time.
ITEMS = 4096
#: Words of an item that make one query vector.
PART = PASSAGE
COSINE = 0.5
LCS_SHARE = 0.52
COVERAGE = 0.45
#: A term in more than this share of all passages weighs nothing in a vector, but counts in a subsequence.
STOP_SHARE = 0.05
#: Tasks whose sums are added up at a time, and terms of such a sum that go together.
FAN_IN, BLOCK = 64, 1024
#: Vectors that are added up in one go, and such sums that are made side by side.
RUN, SIDE = 32, 512
#: Words of surroundings that are checked side by side.
GATHERED = 1 << 16

#: Taken off both ends of a token.
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‚…–—¿¡·•"
ANSWER = re.compile(r"(?:^|\n|\s)(?:answer|réponse|antwort|respuesta|a)\s*:\s*(.+?)\s*$", re.I | re.S)

RESULT = "key long, sum long, item_id long, lcs_words long, item_words long, cosine double"


def _numbers(words: pa.Array) -> np.ndarray:
    """1 and more: XXH32 of each word; 0 for an empty one. Words of like lengths, below XXH32's blocks of 16 bytes, side by side."""
    words = words.cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(16, np.uint8)])
    fours, sizes, out = np.lib.stride_tricks.sliding_window_view(raw, 4), np.diff(off), np.zeros(len(words), np.uint32)
    turned = lambda h, n: h << np.uint32(n) | h >> np.uint32(32 - n)
    one, two, three, four, five = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))
    for size in range(1, 16):
        some = np.flatnonzero(sizes == size)
        at, h = off[some], np.full(len(some), int(five) + size, np.uint32)
        for i in range(0, size - 3, 4):
            h = turned(h + fours[at + i].view("<u4").ravel() * three, 17) * four
        for i in range(size // 4 * 4, size):
            h = turned(h + raw[at + i].astype(np.uint32) * five, 11) * one
        h = (h ^ h >> np.uint32(15)) * two
        h = (h ^ h >> np.uint32(13)) * three
        out[some] = h ^ h >> np.uint32(16)
    for i in np.flatnonzero(sizes > 15).tolist():
        out[i] = xxhash.xxh32_intdigest(raw[off[i] : off[i + 1]].tobytes())
    out += 1
    return np.where(sizes > 0, np.maximum(out, 1), 0).astype(np.uint32)


def numbers_of(texts: pa.Array) -> list[np.ndarray]:
    """The numbers of each text's words: what white space parts, in lower case, without EDGE; nothing for tokens of EDGE alone."""
    tokens = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    ends = tokens.offsets.to_numpy().astype(np.int64) - tokens.offsets[0].as_py()
    coded = tokens.flatten().dictionary_encode()
    words = pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGE).dictionary_encode()
    known = _numbers(words.dictionary)
    numbers = known[words.indices.to_numpy()][coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint32)
    held = numbers > 0
    ends = np.concatenate(([0], np.cumsum(held)))[ends]
    return np.split(numbers[held], ends[1:-1])


def terms_of(numbers: np.ndarray) -> np.ndarray:
    return (numbers % np.uint32(TERMS)).astype(np.int64)


def _number(docs: DataFrame, text_column: str) -> DataFrame:
    """kind 0: key, sum and the numbers of a text with words. kind 1: of a task, the passages that hold each term, and all its passages."""
    names = ["kind", "key", "sum", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1, np.int64)
        for part in slices(batches, 2):
            texts = numbers_of(part.column(2))
            sizes = np.array([len(x) for x in texts], np.int64)
            passages = -(-sizes // PASSAGE)
            held[TERMS] += passages.sum()
            where = np.repeat(np.cumsum(passages) - passages, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // PASSAGE
            pairs = where * TERMS + terms_of(np.concatenate([np.zeros(0, np.uint32), *texts]))
            pairs.sort()
            held[:TERMS] += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % TERMS, minlength=TERMS)
            full = pa.array(sizes > 0)
            blobs = pa.array([x.tobytes() for x in texts], pa.binary())
            rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int32)), part.column(0), part.column(1), blobs], names)
            yield rows.filter(full)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.array([0], pa.int64())] * 2, pa.array([held.tobytes()], pa.binary())], names)

    return docs.select(key_of("doc_id").alias("key"), sum_of(text_column), F.col(text_column)).mapInArrow(tidy(run), "kind int, key long, sum long, numbers binary")


def _passage_counts(numbered: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                held += np.frombuffer(blob.as_buffer(), np.int64)
        where = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(held[where])], ["term", "n"])

    rows = numbered.where("kind = 1").select("numbers").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(TERMS + 1, np.int64)
    for r in rows.collect():  # a row for each term
        counts[r.term] = r.n
    return counts


def weights(counts: np.ndarray) -> np.ndarray:
    """Inverse passage frequencies; none for terms of more than STOP_SHARE of the passages, unless these are few."""
    passages = max(1, int(counts[TERMS]))
    out = np.log((1 + passages) / (1 + counts[:TERMS])) + 1
    out[counts[:TERMS] > max(STOP_SHARE * passages, 10)] = 0
    return out.astype(np.float32)


def _gathered(blobs, step: int, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of some texts; their weighty terms with their cells (step words each; a cell is left free between texts), each once in a cell; each text's first cell."""
    texts = [np.frombuffer(blob.as_buffer(), np.uint32) for blob in blobs]
    sizes = np.array([len(x) for x in texts], np.int64)
    room = sizes // step + 2
    firsts = np.cumsum(room) - room
    ids = terms_of(np.concatenate([np.zeros(0, np.uint32), *texts]))
    cells = np.repeat(firsts, sizes) + (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // step
    pairs = (cells * TERMS + ids)[weight[ids] > 0]
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]  # a word that fills a passage must not hide the others
    return texts, pairs % TERMS, pairs // TERMS, firsts


def _sums(vectors: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, and the sums of their terms' vectors."""
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[starts], _added(np.ascontiguousarray(vectors), ids, starts)  # take() copies an array whose rows are not in one piece, each time


def _added(vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of vectors[ids] from each start to the next: runs of like lengths side by side, one place at a time; long runs are cut and their parts added up again."""
    sizes, out = np.diff(starts, append=len(ids)), np.empty((len(starts), vectors.shape[1]), np.float32)
    parts = -(-sizes // RUN)
    if len(parts) and parts.max() > 1:
        first = np.cumsum(parts) - parts
        cut = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * RUN
        return _added(_added(vectors, ids, cut), np.arange(len(cut)), first)
    order, room = np.argsort((RUN - sizes).astype(np.uint8), kind="stable"), np.empty((SIDE, vectors.shape[1]), np.float32)
    for a in range(0, len(order), SIDE):  # bounded memory
        some = order[a : a + SIDE]
        at, n = starts[some], sizes[some]
        total = vectors[ids[at]]
        for j in range(1, int(n[0])):
            longer = int(np.searchsorted(-n, -j))
            total[:longer] += np.take(vectors, ids[at[:longer] + j], axis=0, out=room[:longer], mode="clip")
        out[some] = total
    return out


def _some(batch: pa.RecordBatch, column: int, words: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Texts of about so many words at a time."""
    return slices(iter([batch]), column, 4 * words)


def _latent_sum(numbered: DataFrame, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A'(A R), terms by rank, over all passages of all texts. start: R."""
    sent = numbered.sparkSession.sparkContext.broadcast((weight, start.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weight, start = sent.value
        vectors, total = start * weight[:, None], np.zeros(start.shape, np.float32)
        for batch in batches:
            for part in _some(batch, 0):
                _, ids, cells, _ = _gathered(part.column(0), PASSAGE, weight)
                if not len(ids):
                    continue
                found, sums = _sums(vectors, ids, cells)
                place = np.cumsum(np.diff(cells, prepend=cells[0]) != 0)
                norms = np.bincount(place, weights=weight[ids].astype(np.float64) ** 2)
                sums /= norms[:, None].astype(np.float32)
                order = np.argsort(ids.astype(np.uint16), kind="stable")
                terms, back = _sums(sums, place[order], ids[order])
                total[terms] += back * weight[terms, None]
        blocks = [total[a : a + BLOCK].tobytes() for a in range(0, TERMS, BLOCK)]
        task = [TaskContext.get().partitionId()] * len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(task, pa.int64()), pa.array(blocks, pa.binary())], ["block", "task", "sums"])

    def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = None, 0
        for batch in group:
            for i in range(batch.num_rows):
                head = head or batch.slice(i, 1)
                total = total + np.frombuffer(batch.column(2)[i].as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "task", "sums"])

    schema = "block int, task long, sums binary"
    texts = numbered.where("kind = 0").select("numbers")
    sums, tasks = texts.mapInArrow(tidy(run), schema), texts.rdd.getNumPartitions()
    while tasks > 1:
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN))
        sums, tasks = sums.groupBy("block", "task").applyInArrow(lambda t: pa.Table.from_batches(added(iter(t.to_batches()))), schema), -(-tasks // FAN_IN)
    out = np.zeros(start.shape)
    for r in sums.collect():  # a row for each block of terms
        block = np.frombuffer(r.sums, np.float32).reshape(-1, start.shape[1])
        out[r.block * BLOCK : r.block * BLOCK + len(block)] += block
    return out


def lcs_length(masks: dict[int, int], n: int, words) -> int:
    """Of an item of n words, given the places of each, and a row of words: bit-parallel."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Item:
    """An item of the benchmark, as the checks need it."""

    def __init__(self, number: int, words: np.ndarray, answer: np.ndarray, weight: np.ndarray):
        self.id, self.n, self.words, self.answer = number, len(words), frozenset(words.tolist()), answer.tolist()
        self.masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.weight = {w: float(weight[w % TERMS]) for w in self.masks}
        self.mass = sum(self.weight.values())
        # of each term the weight and number of its words, and what held() asks of both, less what sums in another order may differ by
        self.terms, which = np.unique(terms_of(np.array(list(self.masks), np.uint32)), return_inverse=True)
        self.shares = np.stack([np.bincount(which, list(self.weight.values())), np.bincount(which)], axis=1).astype(np.float32)
        self.least = np.array([COVERAGE * self.mass, LCS_SHARE * len(self.words) / 2]) * (1 - 1e-4)

    def held(self, near: np.ndarray) -> int:
        """The words of the longest common subsequence, if near holds or paraphrases the item; else 0."""
        words = near.tolist()
        there = self.words.intersection(words)
        if sum(self.weight[w] for w in there) < COVERAGE * self.mass or len(there) < LCS_SHARE * len(self.words) / 2:
            return 0
        length = lcs_length(self.masks, self.n, words)
        return length if length >= LCS_SHARE * self.n and self.answered(words) else 0

    def answered(self, words: list[int]) -> bool:
        n = len(self.answer)
        return not n or any(words[i : i + n] == self.answer for i, w in enumerate(words) if w == self.answer[0])


def window(numbers: np.ndarray, cell: int, n: int) -> np.ndarray:
    """What surrounds the passage that begins at a cell, for an item of n words."""
    return numbers[max(0, cell * STEP - n) : cell * STEP + PASSAGE + n]


def _candidates(ids: np.ndarray, cells: np.ndarray, vectors: np.ndarray, queries: np.ndarray, block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First cells, queries and latent cosines of the passages near a query. A passage is a cell and the one after it."""
    found, sums = _sums(vectors, ids, cells)
    joined = np.flatnonzero(np.diff(found) == 1)
    passages = sums.copy()
    passages[joined] += sums[joined + 1]
    passages /= np.maximum(np.linalg.norm(passages, axis=1), 1e-9)[:, None]
    for a in range(0, len(found), block):
        for b in range(0, len(queries), 256):
            cosine = (passages[a : a + block] @ queries[b : b + 256].T).ravel()
            near = np.flatnonzero(cosine >= COSINE)
            yield found[a + near // len(queries[b : b + 256])], b + near % len(queries[b : b + 256]), np.minimum(cosine[near], 1)


def _together(found: Iterator[tuple[np.ndarray, ...]], least: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in the same order, least or more of them at a time."""
    held, rows = [], 0
    for x in found:
        held.append(x)
        rows += len(x[0])
        if rows >= least:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, rows = [], 0
    if rows:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _promising(terms: np.ndarray, begins: np.ndarray, firsts: np.ndarray, cells: np.ndarray, owners: np.ndarray, items: list[Item]) -> np.ndarray:
    """Whether a cell's surroundings may pass the first checks of its item's held(): the same on terms, for all cells of an item at once. terms: of all texts' words; begins: where each text's begin, and the end."""
    out = np.zeros(len(cells), bool)
    text = np.searchsorted(firsts, cells, side="right") - 1
    begin, end = begins[text], begins[text + 1]
    at = begin + (cells - firsts[text]) * STEP
    order = np.argsort(owners, kind="stable")
    starts = np.flatnonzero(np.diff(owners[order], prepend=-1))
    for mine in np.split(order, starts[1:]):
        item = items[owners[mine[0]]]
        place, steps, wide = np.zeros(TERMS, np.int32), np.arange(PASSAGE + 2 * item.n, dtype=begins.dtype), len(item.terms) + 1
        place[item.terms] = np.arange(1, len(item.terms) + 1)
        rows = max(1, GATHERED // len(steps))
        for some in np.split(mine, range(rows, len(mine), rows)):
            low, high = np.maximum(at[some] - item.n, begin[some]), np.minimum(at[some] + PASSAGE + item.n, end[some])
            # beyond its end the last word again: what is there stays the same
            near = place.take(terms.take(np.minimum(low[:, None] + steps, high[:, None] - 1)))
            near += np.arange(0, wide * len(some), wide, dtype=np.int32)[:, None]
            there = np.zeros((len(some), wide), np.float32)
            there.ravel()[near] = 1
            out[some] = (there[:, 1:] @ item.shares >= item.least).all(axis=1)
    return out


def _search(numbered: DataFrame, weight: np.ndarray, vectors: np.ndarray, items: list[Item], owner: np.ndarray, queries: np.ndarray) -> DataFrame:
    sent = numbered.sparkSession.sparkContext.broadcast((weight, vectors, items, owner, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, vectors, items, owner, queries = sent.value
        for batch in batches:
            out = []
            for part in _some(batch, 2):
                texts, ids, cells, firsts = _gathered(part.column(2), STEP, weight)
                terms, begins = terms_of(np.concatenate([np.zeros(0, np.uint32), *texts])).astype(np.uint16), np.cumsum([0, *map(len, texts)])
                best: dict[tuple[int, int], tuple] = {}
                for near, query, cosines in _together(_candidates(ids, cells, vectors, queries)):
                    some = _promising(terms, begins, firsts, near, owner[query], items)
                    near, own = near[some], owner[query[some]]
                    for cell, text, i, cosine in zip(near.tolist(), (np.searchsorted(firsts, near, side="right") - 1).tolist(), own.tolist(), cosines[some].tolist(), strict=True):
                        had = best.get((text, i), (0, 0, 0.0))
                        if had[0] < items[i].n:
                            length = items[i].held(window(texts[text], cell - int(firsts[text]), items[i].n))
                            if length:
                                best[text, i] = max(had, (length, items[i].n, cosine))
                keys, sums = part.column(0), part.column(1)
                out += [(keys[t].as_py(), sums[t].as_py(), items[i].id, *x) for (t, i), x in best.items()]
            kinds = [pa.int64()] * 5 + [pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "sum", "item_id", "lcs_words", "item_words", "cosine"])

    return numbered.where("kind = 0").select("key", "sum", "numbers").mapInArrow(tidy(run), RESULT)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """ITEMS items at a time: id, words, words of the answer. Items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    for block in itertools.batched(rows, ITEMS):
        words = numbers_of(pa.array([r[1] for r in block], pa.string()))
        answers = numbers_of(pa.array([m[1] if (m := ANSWER.search(r[1] or "")) else "" for r in block], pa.string()))
        yield [(r[0], w, a) for r, w, a in zip(block, words, answers, strict=True) if len(w)]


def _parts(items: list[tuple], weight: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items' parts as queries: the item of each, and the sums of its terms' vectors, of length one. The last part reaches back to be whole."""
    owner, rows = [], []
    for i, (_, words, _) in enumerate(items):
        for a in range(0, len(words), PART):
            terms = terms_of(words[max(0, min(a, len(words) - PART)) : a + PART])
            row = vectors[np.unique(terms)].sum(axis=0)
            if (norm := float(np.linalg.norm(row))) > 1e-9:
                owner.append(i)
                rows.append(row / norm)
    return np.array(owner, np.int64), np.array(rows, np.float32).reshape(-1, vectors.shape[1])


def latent_space(numbered: DataFrame, benchmark: DataFrame, weight: np.ndarray) -> np.ndarray | None:
    """Terms by rank: the terms' latent vectors. None without items.

    The latent directions are those of the corpus and of what is near the benchmark,
    each by the inverse of its own strength, so that a language or a topic does not
    make all its passages alike; a term's vector has its weight for its length.
    """
    rng = np.random.default_rng(7)
    start, some = rng.standard_normal((TERMS, RANK)), False
    start[:, RANK // 2 :] = 0
    for items in _blocks(benchmark):
        for _, words, _ in items:
            some = True
            terms, tf = np.unique(terms_of(words), return_counts=True)
            q = tf * weight[terms]
            start[np.ix_(terms, range(RANK // 2, RANK))] += np.outer(q / max(1e-9, float(np.linalg.norm(q))), rng.standard_normal(RANK - RANK // 2))
    if not some:
        return None
    basis, strength, _ = np.linalg.svd(_latent_sum(numbered, weight, start), full_matrices=False)
    some = strength > 1e-6 * max(1e-30, strength[0])
    vectors = basis[:, some] / np.sqrt(strength[some])  # the strengths of a sum A'A are squares of A's
    return (vectors * (weight / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12))[:, None]).astype(np.float32, order="C")  # basis[:, some] lies by columns


def contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """key, sum, item_id, lcs_words, item_words, cosine: the items that a row holds or paraphrases."""
    numbered = materialise(_number(docs, text_column), "numbers")
    weight = weights(_passage_counts(numbered))
    vectors = latent_space(numbered, benchmark, weight)
    every = docs.sparkSession.createDataFrame([], RESULT)
    if vectors is None:
        return every
    for items in _blocks(benchmark):
        owner, queries = _parts(items, weight, vectors)
        if len(owner):
            every = every.union(_search(numbered, weight, vectors, [Item(*x, weight) for x in items], owner, queries))
    return every


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("lcs_words", "item_words", "cosine"), F.struct("lcs_words", "cosine")).alias("best")
    return found.groupBy("key", "item_id").agg(best).select(id_of("key").alias("doc_id"), "item_id", "best.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold or paraphrase an item go."""
    bounded(spark)
    key, check = fresh("__key", docs), fresh("__sum", docs)
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("key").alias(key), F.col("sum").alias(check)).distinct()
    marked = docs.withColumns({key: key_of("doc_id"), check: sum_of("text")})
    return marked.join(materialise(found, "contaminated"), [key, check], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
