"""Function clones: shingles, MinHash signatures, bands, alignment, components, families."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ngrams
from . import minhash

PRIME = minhash.PRIME
PERMUTATIONS = 128
MIN_OPS = 10


def constants(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """Fixed multipliers and offsets of the permutations: a linear congruential sequence."""
    out, x = [], 1
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % 2147483648
            pair.append(x % (1 << 30) + 1)
        out.append(tuple(pair))
    return out


def shingled(functions: DataFrame, k: int, least: int = MIN_OPS) -> DataFrame:
    """binary, func, shingles: the set of k-grams of functions of least opcodes or more."""
    return functions.where(F.size("ops") >= least).select("binary", "func", F.array_distinct(ngrams("ops", k)).alias("shingles"))


def shingle_hash(s: Column) -> Column:
    """32 bits of the shingle's MD5."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def signatures(sets: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """binary, func, sig: a function's least hash under each permutation. The products of a function's hashes and the permutations are one Arrow kernel: 62 bits each."""
    hashed = sets.select("binary", "func", F.transform("shingles", shingle_hash).alias("h"))
    a, b = (np.array(x, np.int64) for x in zip(*constants(permutations), strict=True))

    def run(batches):
        for batch in batches:
            out = []
            for h in batch.column(2):
                h = h.values.to_numpy()
                least = np.full(permutations, PRIME, np.int64)
                for i in range(0, len(h), 8192):
                    least = np.minimum(least, ((h[i : i + 8192, None] * a + b) % PRIME).min(axis=0))
                out.append(least)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["binary", "func", "sig"])
            # not a filter of the plan: Spark would push it below the hashes and make these once for each n-gram
            yield rows.filter(pa.array([len(h) > 0 for h in batch.column(2)], pa.bool_()))

    return hashed.mapInArrow(run, "binary string, func long, sig array<long>")


def band_shape(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows that make the false positives and negatives around the threshold least, in area."""
    best, grid = None, (np.arange(1000) + 0.5) / 1000
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            chance = 1 - (1 - grid**r) ** b
            cost = 0.5 * chance[grid < threshold].sum() + 0.5 * (1 - chance[grid >= threshold]).sum()
            if best is None or cost < best[0]:
                best = (cost, b, r)
    return best[1], best[2]


def candidates(signed: DataFrame, threshold: float, permutations: int = PERMUTATIONS) -> DataFrame:
    """id1, id2 (functions) that agree in a band, and the share of permutations in which they agree.

    Functions with one signature are one group; groups are joined by bands, so
    copies do not multiply the pairs. A pair is a representative and a member.
    """
    b, r = band_shape(threshold, permutations)
    whole = signed.select("func", "sig")
    groups = whole.groupBy("sig").agg(F.min("func").alias("head"))
    bands = groups.select("head", "sig", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.md5(F.array_join(F.slice("sig", i * r + 1, r).cast("array<string>"), ",")).alias("h")) for i in range(b)))).alias("e"))
    near = bands.select("head", "e.*")
    pairs = near.toDF("x", "band", "h").join(near.toDF("y", "band", "h"), ["band", "h"]).where("x < y").select("x", "y").distinct()
    sig = groups.select("head", "sig")
    agree = F.size(F.filter(F.zip_with("sx", "sy", lambda p, q: p == q), lambda z: z)) / permutations
    between = pairs.join(sig.toDF("x", "sx"), "x").join(sig.toDF("y", "sy"), "y").select(F.col("x").alias("id1"), F.col("y").alias("id2"), agree.alias("estimate"))
    copies = whole.join(groups, "sig").where("func <> head").select(F.col("head").alias("id1"), F.col("func").alias("id2"), F.lit(1.0).alias("estimate"))
    return between.union(copies)


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds jaccard of the pairs' shingle sets."""
    s = sets.select("func", "shingles")
    both = pairs.join(s.toDF("id1", "s1"), "id1").join(s.toDF("id2", "s2"), "id2")
    return both.withColumn("jaccard", F.size(F.array_intersect("s1", "s2")) / F.size(F.array_union("s1", "s2"))).drop("s1", "s2")


def marks(functions: DataFrame, sizes: tuple[int, ...], shapes: list[tuple[int, int]], permutations: int = PERMUTATIONS) -> DataFrame:
    """func, size (its place in sizes), sig, same, bands: 128 bits of the signature and of the whole sequence, and a mark for each band of each shape."""
    ops = functions.where(F.col("func").isNotNull()).select("func", "ops")
    a, b = (np.array(x, np.int64) for x in zip(*constants(permutations), strict=True))

    def run(batches):
        for batch in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            rows, same, out = minhash.Sequences(batch.column(1)), [], [[] for _ in range(5)]
            for place, k in enumerate(sizes):
                h, row = rows.hashes(k)
                for i, s in enumerate(minhash.least(h, row, batch.num_rows, a, b)):
                    if len(same) <= i:
                        same.append(rows.whole(i))
                    if rows.ends[i] - rows.starts[i] >= max(k, MIN_OPS):
                        bands = b"".join(minhash.mark(s[j * r : j * r + r].tobytes())[: minhash.MARK] for n, r in shapes for j in range(n))
                        for c, v in zip(out, (batch.column(0)[i].as_py(), place, minhash.mark(s.tobytes()), same[i], bands), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["func", "size", "sig", "same", "bands"])

    return ops.mapInArrow(run, "func long, size int, sig binary, same binary, bands binary")


#: Stands in place of a slot for the copies of a group's head.
COPY = 1 << 20


def _slots(marked: DataFrame, bands: int) -> DataFrame:
    """h, slot, id1, id2, same: for the least function of each signature a row for each band; slot holds size, band and 32 bits of the mark, h the other 64. For each other one a row with its head."""
    dealt = marked.repartition("size", "sig").sortWithinPartitions("size", "sig", "func")

    def run(batches):
        group, head, whole = None, None, None
        for batch in batches:
            heads, copies = [], []
            for i, (size, sig, func, same) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "sig", "func", "same")), strict=True)):
                if (size, sig) != group:
                    group, head, whole = (size, sig), func, same
                    heads.append(i)
                elif func != head:
                    copies.append((func, COPY + size << 32, head, func, same == whole))
            told = batch.take(pa.array(heads, pa.int64()))
            raw = np.frombuffer(b"".join(told.column("bands").to_pylist()), np.uint8).reshape(-1, minhash.MARK)
            h, low = (np.ascontiguousarray(raw[:, x:y]).view(t).ravel() for x, y, t in ((0, 8, np.int64), (8, 12, np.uint32)))
            place = np.repeat(told.column("size").to_numpy().astype(np.int64) * bands, bands) + np.tile(np.arange(bands), len(heads))
            ids = np.repeat(told.column("func").to_numpy(), bands)
            columns = [h, place << 32 | low.astype(np.int64), ids, pa.nulls(len(ids), pa.int64()), np.zeros(len(ids), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            if copies:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*copies, strict=True)], names)

    names = ["h", "slot", "id1", "id2", "same"]
    return dealt.mapInArrow(run, "h long, slot long, id1 long, id2 long, same boolean")


def _met(slots: DataFrame, bands: int) -> DataFrame:
    """id1, id2, sizes, same: the pairs that share a slot, and copies with their heads; sizes has a bit for each place in sizes. A bucket's ids are held in one task."""
    dealt = slots.repartition("h", "slot").sortWithinPartitions("h", "slot", "id1")
    names = ["id1", "id2", "sizes", "same"]

    def told(x, y, size, same):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(np.broadcast_to(np.int64(1) << np.asarray(size), len(x))), pa.array(np.broadcast_to(same, len(x)))], names)

    def pairs(ids, slot):
        ids = np.unique(ids)
        for i in range(len(ids) - 1):
            rest = ids[i + 1 :]
            for j in range(0, len(rest), 1 << 16):
                yield told(np.full(len(rest[j : j + (1 << 16)]), ids[i]), rest[j : j + (1 << 16)], (slot >> 32) // bands, False)

    def buckets(batches):
        """Copies as they come, and the pairs of each bucket."""
        now, held = None, []
        for batch in batches:
            copied = batch.filter(batch.column("id2").is_valid())
            if copied.num_rows:
                yield told(copied.column("id1"), copied.column("id2"), (copied.column("slot").to_numpy() >> 32) - COPY, copied.column("same").to_numpy(zero_copy_only=False))
            batch = batch.filter(batch.column("id2").is_null())
            if not batch.num_rows:
                continue
            h, slot, ids = (batch.column(c).to_numpy() for c in ("h", "slot", "id1"))
            starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (slot[1:] != slot[:-1])]))
            ends = np.append(starts[1:], len(h))
            # a bucket of one row matters at the batch's ends alone
            for i in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(h))).tolist():
                key, part = (h[starts[i]], slot[starts[i]]), ids[starts[i] : ends[i]]
                if key != now:
                    if sum(map(len, held)) > 1:
                        yield from pairs(np.concatenate(held), int(now[1]))
                    now, held = key, []
                held.append(part)
        if sum(map(len, held)) > 1:
            yield from pairs(np.concatenate(held), int(now[1]))

    def run(batches):
        ready, rows = [], 0
        for x in buckets(batches):
            ready.append(x)
            rows += x.num_rows
            if rows >= 1 << 16:
                yield _joined(ready)
                ready, rows = [], 0
        if ready:
            yield _joined(ready)

    return dealt.mapInArrow(run, "id1 long, id2 long, sizes long, same boolean").groupBy("id1", "id2").agg(F.bit_or("sizes").alias("sizes"), F.max("same").alias("same"))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Bits that say which ids are wanted: what is broadcast is a row for each 64 of them at most.
WANTED = 1 << 24
#: Functions on each side of a block of pairs.
BLOCK = 512
#: Words of blocks that are given to a kernel together.
WORDS = 1 << 20


def only(rows: DataFrame, id: str, wanted: DataFrame) -> DataFrame:
    """The rows whose id is among wanted(id), and a few others: what is not needed is not shuffled. Bounded by WANTED, whatever the number of ids."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(WANTED))
    bits = wanted.select(place("id").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__bits"))
    p = place(id)
    return rows.withColumn("__word", F.floor(p / 64)).join(F.broadcast(bits), "__word").where(F.getbit("__bits", (p % 64).cast("int")) == 1).drop("__word", "__bits")


def side_by_side(pairs: DataFrame, functions: DataFrame, kernel, schema: str) -> DataFrame:
    """What kernel(ops by id, pairs as (id1, id2, value)) makes of blocks of pairs(id1, id2, value); small blocks are given together.

    A function's center is the least of it and its neighbours; a pair is done at the center of id1, so the sequences
    of a group of near copies are moved once. A center's pairs are cut into blocks by both ids, so a task holds 2 BLOCK
    sequences of a block or about that many, and of small blocks before it as many again. Sequences without a pair are not shuffled.
    """
    edges = pairs.select("id1", "id2").union(pairs.select("id2", "id1")).toDF("id1", "b")
    centers = edges.groupBy("id1").agg(F.least("id1", F.min("b")).alias("center"))
    at = pairs.join(centers, "id1")
    parts = at.groupBy("center", "id2").agg(F.lit(1)).groupBy("center").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    at = written(at.join(parts, "center").select("center", cut("id1").alias("x"), cut("id2").alias("y"), "id1", "id2", "value"), "blocks")
    block = ["center", "x", "y"]
    needs = written(at.select(F.col("id1").alias("id"), *block).union(at.select("id2", *block)).distinct().groupBy("id").agg(F.collect_list(F.struct(*block)).alias("at")), "needs")
    found = only(functions.select(F.col("func").alias("id"), "ops"), "id", needs).join(needs, "id").select(F.explode("at").alias("at"), "id", "ops")
    kind = dict(pairs.dtypes)["value"]
    none = lambda t: F.lit(None).cast(t)
    rows = found.select("at.*", F.col("id").alias("id1"), none("long").alias("id2"), none(kind).alias("value"), "ops").union(at.select(*block, "id1", "id2", "value", none("array<string>")))
    rows = rows.repartition(*block).sortWithinPartitions(*block, F.col("id2").asc_nulls_first())

    def run(batches):
        now, ops, words, held = None, {}, 0, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for i, (key, x, y, v) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in range(3, 6)), strict=True)):
                full = len(held) >= 4096 or key != now and (len(ops) >= 2 * BLOCK or words >= WORDS)
                if full and held:
                    yield from kernel(ops, held)
                if full:
                    ops, words, held = (ops, words, []) if key == now else ({}, 0, [])
                now = key
                if y is None:
                    ops[x] = batch.column(6)[i].as_py()
                    words += len(ops[x])
                elif x in ops and y in ops:
                    held.append((x, y, v))
        if held:
            yield from kernel(ops, held)

    return rows.mapInArrow(run, schema)


def best_pairs(functions: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), thresholds: tuple[float, ...] = (0.7, 0.9), permutations: int = PERMUTATIONS) -> DataFrame:
    """id1, id2, jaccard, same: the candidates of all shingle sizes and thresholds, each with its best similarity over the sizes that found it; same: equal sequences.

    As the candidates of each size and threshold: the shingles are hashed in one pass, of which only marks are kept, and
    sequences are moved only for pairs of different ones.
    """
    shapes = [band_shape(t, permutations) for t in thresholds]
    bands = sum(n for n, _ in shapes)
    met = written(_met(_slots(marks(functions, sizes, shapes, permutations), bands), bands), "met")

    def kernel(ops, pairs):
        code, sets = {}, {}

        def shingles(f, k):
            if (f, k) not in sets:
                o = ops[f]
                sets[f, k] = {code.setdefault(" ".join(o[i : i + k]), len(code)) for i in range(len(o) - k + 1)}
            return sets[f, k]

        out = []
        for x, y, found in pairs:
            best = 0.0
            for place, k in enumerate(sizes):
                if found >> place & 1:
                    s, t = shingles(x, k), shingles(y, k)
                    both = len(s & t)
                    best = max(best, both / (len(s) + len(t) - both))
            out.append((x, y, best))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id1", "id2", "jaccard"])

    copies = met.where("same").select("id1", "id2", F.lit(1.0).alias("jaccard"), "same")
    others = side_by_side(met.where("not same").select("id1", "id2", F.col("sizes").alias("value")), functions, kernel, "id1 long, id2 long, jaccard double")
    return copies.union(others.withColumn("same", F.lit(False)))


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """Smith-Waterman's best local score. A row at a time: the chain of gaps to the left is a running maximum."""
    if not len(a) or not len(b):
        return 0
    steps = -gap * np.arange(1, len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        now = np.maximum(np.maximum(row[:-1] + np.where(b == x, match, mismatch), row[1:] + gap), 0)
        now = np.maximum.accumulate(now + steps) - steps
        row[1:] = now
        best = max(best, int(now.max()))
    return best


def common_core(a: list, b: list) -> list:
    """A longest common subsequence; ties go up.

    A row of the table is an integer of bits: a bit is off where the row's lengths grow by one. On the way back one row above
    is enough; rows are kept at steps of the root of their number and those between are made once more.
    """
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b, tail = a[: len(a) - end], b[: len(b) - end], a[len(a) - end :]
    full, at = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    masks = {}
    for x in set(a) & at.keys():
        if len(at[x]) < 16:
            masks[x] = sum(1 << j for j in at[x])
            continue
        bits = np.zeros(len(b), np.uint8)
        bits[at[x]] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def below(row, words):
        rows = [row]
        for x in words:
            hit = row & masks.get(x, 0)
            row = ((row + hit) | (row - hit)) & full
            rows.append(row)
        return rows

    step = math.isqrt(len(a)) + 1
    kept = [full]
    for i in range(0, len(a), step):
        kept.append(below(kept[-1], a[i : i + step])[-1])
    out, i, j, seen = [], len(a), len(b), full
    left, rows, first = j - kept[-1].bit_count(), [], i
    while left:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j, left, seen = i - 1, j - 1, left - 1, seen >> 1
            continue
        if i - 1 < first or not rows:
            first = (i - 1) // step * step
            rows = below(kept[first // step], a[first : i - 1])
        if j - (rows[i - 1 - first] & seen).bit_count() == left:
            i -= 1
        else:
            j, seen = j - 1, seen >> 1
    return out[::-1] + tail


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 2, mismatch: int = -1, gap: int = -1) -> np.ndarray:
    """The scores of align, of pairs of codes (0 or more) side by side: pairs of like lengths go through one table, a diagonal at a time.

    Of the table only a band is made. An alignment that leaves it by w cells has w + 1 matches less than the shorter side
    at least, so a score that no such one can pass is the whole table's; for the others, their score tells how wide a band shows it.
    """
    # the shorter one is a: the score is the same both ways
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    least = np.array([len(a) for a, _ in sides], np.int64)
    scores = np.zeros(len(pairs), np.int64)
    left, beside = np.flatnonzero(least), least // 12 + 8
    while len(left):
        shown = _banded(sides, left, beside, scores, match, mismatch, gap)
        left = left[~shown]
        beside[left] = least[left] - 1 - scores[left] // match
    return scores


def _banded(sides: list[tuple[np.ndarray, np.ndarray]], which: np.ndarray, beside: np.ndarray, scores: np.ndarray, match: int, mismatch: int, gap: int) -> np.ndarray:
    """Puts the best scores into scores[which], of alignments in a band that goes beside[i] cells past the corners of pair i; and whether none outside is better."""
    m_of, n_of = (np.array([len(x[s]) for x in sides], np.int64) for s in (0, 1))
    width = n_of - m_of + 2 * beside
    shown = np.zeros(len(sides), bool)
    order = sorted(which.tolist(), key=lambda i: (int(m_of[i]).bit_length(), width[i]))
    while order:
        first = order[0]
        most = max(1, TABLE // min(int(m_of[first]), int(width[first]) // 2 + 1))
        # longer ones and wider bands would pad all others
        few = next((j for j, i in enumerate(order[:most]) if width[i] > 1.25 * width[first] + 16 or int(m_of[i]).bit_length() != int(m_of[first]).bit_length()), most)
        now, order = np.array(order[:few]), order[few:]
        now = now[np.argsort(m_of[now])]
        m, n = int(m_of[now].max()), int(n_of[now].max())
        under, over = int(beside[now].max()), int((n_of[now] - m_of[now] + beside[now]).max())
        kind = np.int16 if match * m < 2**15 - 8 else np.int32
        a, b = np.full((m, len(now)), -1, np.int32), np.full((n, len(now)), -2, np.int32)
        for j, i in enumerate(now.tolist()):
            a[: len(sides[i][0]), j], b[n - len(sides[i][1]) :, j] = sides[i][0], sides[i][1][::-1]
        # row i + 1 holds the cell (i, d - i) of diagonal d; b is turned round, so both sides run upwards
        two, one, new, best = (np.zeros((m + 2, len(now)), kind) for _ in range(4))
        for d in range(m + n - 1):
            lo, hi = max(0, d - n + 1, (d - over + 1) // 2), min(m, d + 1, (d + under) // 2 + 1)
            equal = a[lo:hi] == b[n - 1 - d + lo : n - 1 - d + hi]
            cell = new[lo + 1 : hi + 1]
            np.multiply(equal, kind(match - mismatch), out=cell)
            cell += two[lo:hi]
            cell += kind(mismatch)
            step = np.maximum(one[lo:hi], one[lo + 1 : hi + 1])
            step += kind(gap)
            np.maximum(cell, step, out=cell)
            np.maximum(cell, kind(0), out=cell)
            np.maximum(best[lo + 1 : hi + 1], cell, out=best[lo + 1 : hi + 1])
            new[lo] = new[hi + 1] = 0  # what stands beside the band is older
            two, one, new = one, new, two
        scores[now] = best.max(axis=0)
        shown[now] = scores[now] >= match * np.maximum(m_of[now] - under - 1, n_of[now] - over - 1)
    return shown[which]


#: Cells of a diagonal of align_all's table.
TABLE = 1 << 15


def aligned(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds alignment: the score over twice the shorter length, 1 at most, of whole sequences. Functions below five opcodes give no row. Three diagonals of the table are held at a time; equal sequences need none, and where pairs has a column same, those that it tells are not moved."""

    def kernel(ops, rows):
        words = {}
        code = {f: np.array([words.setdefault(w, len(words)) for w in o], np.int32) for f, o in ops.items() if len(o) >= 5}
        rows = [r for r in rows if r[0] in code and r[1] in code]
        scores = np.ones(len(rows))
        other = [i for i, (x, y, _) in enumerate(rows) if not np.array_equal(code[x], code[y])]
        raw = align_all([(code[rows[i][0]], code[rows[i][1]]) for i in other])
        scores[other] = np.minimum(1.0, raw / [2 * min(len(code[rows[i][0]]), len(code[rows[i][1]])) for i in other])
        x, y, j = (pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64())))
        yield pa.RecordBatch.from_arrays([x, y, j, pa.array(scores)], ["id1", "id2", "jaccard", "alignment"])

    told = "same" in pairs.columns
    others = side_by_side((pairs.where("not same") if told else pairs).select("id1", "id2", F.col("jaccard").alias("value")), functions, kernel, "id1 long, id2 long, jaccard double, alignment double")
    # the same ones have MIN_OPS opcodes or more
    return others.union(pairs.where("same").select("id1", "id2", "jaccard", F.lit(1.0).alias("alignment"))) if told else others


def clone_type(j: Column, s: Column) -> Column:
    """0 none; by Jaccard 1 exact, 2 renamed, 3 gapped, if the alignment confirms a clone; one type weaker where the two measures differ by more than 0.3."""
    base = F.when((j < 0.5) | (s < 0.3), 0).when(j >= 0.95, 1).when(j >= 0.7, 2).otherwise(3)
    return F.when(base == 0, 0).when(F.abs(j - s) > 0.3, F.least(base + 1, F.lit(3))).otherwise(base)


def shared_path(spark: SparkSession, name: str) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): least labels of neighbours, then of labels, each round written."""
    both = written(edges.select("id1", "id2").union(edges.select("id2", "id1")).distinct().toDF("a", "b"), "edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(now.toDF("b", "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("to"))
        new = written(step.join(now.toDF("to", "next"), "to").select("node", F.least("to", "next").alias("component"), "was"), "labels")
        now = new.select("node", "component")
        if not new.where("component <> was").limit(1).count():
            return now


def families(pairs: DataFrame, parts: DataFrame, functions: DataFrame) -> DataFrame:
    """A row for each component of two functions or more: its members, type, binaries, conserved core and divergence.

    The core is a fold of longest common subsequences over the whole sequences of all
    members in order. A sequence that an earlier member has, by 128 bits, changes nothing and
    is not moved; the others are streamed in order, so a task holds one core and one member.
    """
    sizes = functions.select(F.col("func").alias("node"), "binary", F.size("ops").alias("n"), F.xxhash64("ops").alias("o1"), F.xxhash64(F.lit(1), "ops").alias("o2"))
    types = pairs.join(parts.withColumnRenamed("node", "id1"), "id1").groupBy("component", "clone_type").agg(F.count("*").alias("c"))
    dominant = types.groupBy("component").agg(F.max_by("clone_type", F.struct("c", (-F.col("clone_type")).alias("t"))).alias("clone_type"))
    named = written(parts.join(only(sizes, "node", parts.select(F.col("node").alias("id"))), "node"), "members")
    rows = named.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.sort_array(F.collect_set("binary")).alias("binary_names"), F.count("*").alias("size"), F.avg("n").alias("mean_len")).where("size >= 2")
    firsts = written(named.groupBy("component", "o1", "o2").agg(F.min("node").alias("node")).select("component", "node"), "firsts")
    heads = firsts.join(only(functions.select(F.col("func").alias("node"), F.col("ops").alias("o")), "node", firsts.select(F.col("node").alias("id"))), "node")
    heads = heads.repartition("component").sortWithinPartitions("component", "node").select("component", "o")

    def fold(batches):
        names, now, core = ["component", "conserved_core"], None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([core], pa.list_(pa.string()))], names)
        for batch in batches:
            for component, o in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if component != now:
                    if core is not None:
                        yield told()
                    now, core = component, o.as_py()
                elif core:
                    core = common_core(core, o.as_py())
        if core is not None:
            yield told()

    cores = heads.mapInArrow(fold, "component long, conserved_core array<string>")
    out = rows.join(dominant, "component", "left").join(cores, "component", "left")
    divergence = F.least(F.greatest(1 - F.size("conserved_core") / F.col("mean_len"), F.lit(0.0)), F.lit(1.0))
    return out.select(F.col("component").alias("family"), "members", F.coalesce("clone_type", F.lit(3)).alias("clone_type"), "binary_names", (F.size("binary_names") > 1).alias("is_cross_binary"), "size", "conserved_core", divergence.alias("divergence_score"))
