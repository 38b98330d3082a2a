"""Counts of n-grams without moving their strings: a row for each start, by its first two words, packed in blocks.

The n-grams of all sizes that start at one place are one row of word codes. Rows are dealt out by their first two words, so
one task sees all n-grams of two words or more that begin with these, and counts every size from one sorted block. Codes:
16 bits for the most frequent words (a bounded vocabulary that is sent to all tasks), for others their place among these and
47 bits of MD5. A task sorts the rows of its part, counts equal ones and compresses what is left, column by column.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import ends_with_following

#: Words with a short code; the two codes above are a rare word's and that of no word.
COMMON, RARE, NONE = 65534, 65534, 65535
#: Rows that a task packs at once.
ROWS = 1 << 20
#: Bits of a rare word's hash; its place among the common ones stands above them.
HASHED = 47


def word_counts(functions: DataFrame, by: Column) -> DataFrame:
    """by, word, count. Counted by batch before rows are made."""

    def run(batches):
        for batch in batches:
            words = batch.column(1).flatten()
            group = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy()))
            names = batch.column(0).dictionary_encode()
            t = pa.table({"by": names.indices.take(group), "word": words}).group_by(["by", "word"]).aggregate([([], "count_all")]).combine_chunks()
            for x in t.to_batches():
                yield pa.RecordBatch.from_arrays([names.dictionary.take(x.column("by")), x.column("word"), x.column("count_all")], ["by", "word", "count"])

    return functions.select(by.alias("by"), "ops").mapInArrow(run, "by string, word string, count long").groupBy("by", "word").agg(F.sum("count").alias("count"))


def common_words(counts: DataFrame, most: int = COMMON) -> list[str]:
    """The most frequent words, most of them at most."""
    best = counts.groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in best.select("word").collect()]


def code_of(word: str, order: list[str]) -> int:
    """63 bits of a rare word, none of them below the short codes. order: the common words, ascending."""
    return bisect.bisect(order, word) + 1 << HASHED | int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "little") >> 64 - HASHED


def _codes(words: pa.Array, known: pa.Array, order: list[str]) -> np.ndarray:
    near = pc.index_in(words, known).to_pylist()
    return np.array([code_of(w, order) if c is None else c for c, w in zip(near, words.to_pylist(), strict=True)], np.uint64)


def lines(functions: DataFrame, most: int, by: Column) -> DataFrame:
    """by, line, own: stretches of words and how many of their first places start an n-gram. Those that run on into the next function come from its end alone."""
    inner = functions.where(F.size("ops") >= most).select("binary", F.col("ops").alias("line"), (F.size("ops") - (most - 1)).alias("own"))
    ends = ends_with_following(functions, most - 1).select("binary", F.concat("tail", "following").alias("line"), F.size("tail").alias("own"))
    return inner.union(ends).select(by.alias("by"), "line", "own")


def _distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their columns, equal ones once, with the sums of their counts. rows is (columns, rows)."""
    order = np.lexsort(rows[::-1])
    rows, counts = rows[:, order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if rows.shape[1] else np.zeros(0, int)
    return rows[:, starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _packed(rows: np.ndarray, counts: np.ndarray, rare: np.ndarray) -> tuple[int, int, bytes]:
    """rows: by and codes, rare words' codes from COMMON + 2 on are places in rare."""
    codes, far = rows[1:], rows[1:] >= COMMON + 2
    used, place = np.unique(codes[far], return_inverse=True)
    parts = [np.array([rows.shape[1], len(used), len(place)], np.int64), rare[used - COMMON - 2], rows[0].astype(np.int32), np.where(far, RARE, codes).astype(np.uint16), place.astype(np.int32), counts.astype(np.int64)]
    # the bytes of a number apart: high ones are mostly zero
    raw = b"".join(x.tobytes() if i < 2 else np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for i, x in enumerate(parts))
    return rows.shape[1], len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(by and 64-bit codes, rows) and counts."""
    raw = np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    n, used, far = raw[:24].view(np.int64).tolist()
    at = 24 + 8 * used
    rare = raw[24:at].view(np.uint64)
    out = []
    for count, kind in ((n, np.int32), (most * n, np.uint16), (far, np.int32), (n, np.int64)):
        size = count * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, count).T).view(kind).ravel() if count else np.zeros(0, kind))
        at += size
    by, codes, place, counts = out
    codes = codes.astype(np.uint64)
    codes[codes == RARE] = rare[place]
    return np.concatenate([by.astype(np.uint64)[None], codes.reshape(most, n)]), counts


def _each(batch: pa.RecordBatch, coded, most: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lines: the row of each start, and (most, starts) the codes of the words from there on, none behind the line's end."""
    words = batch.column(1).flatten().dictionary_encode()
    code = coded(words.dictionary)
    length = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
    own, ends = np.minimum(batch.column(2).to_numpy(), length), np.cumsum(length)
    flat = np.concatenate([code[words.indices.to_numpy()] if len(code) else code, np.full(most, none, code.dtype)])
    line = np.repeat(np.arange(len(own)), own)
    start = np.arange(len(line)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(ends - length, own)
    return line, np.array([np.where(start + i < ends[line], flat[start + i], none) for i in range(most)], code.dtype)


def blocks(functions: DataFrame, most: int, by: Column, common: list[str], buckets: int) -> DataFrame:
    """bucket, names, size, data: packed rows. names has the groups that a block's first column numbers."""

    def packed(held):
        names = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
        by = names.indices.to_numpy().astype(np.int64)
        rows = np.concatenate([x[1] for x in held], axis=1)
        far = rows >= COMMON + 2
        rare, place = np.unique(rows[far], return_inverse=True)
        rows = rows.astype(np.int64)  # rare codes of 64 bits are replaced by places
        # by the words, not by their places: a bucket is the same in all tasks
        whole = np.concatenate([x[1][:2] for x in held], axis=1)
        bucket = ((whole[0] * np.uint64(0x9E3779B97F4A7C15) ^ (whole[1] + np.uint64(0x7F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(buckets)
        rows[far] = place + COMMON + 2
        rows, counts = _distinct(np.concatenate([bucket.astype(np.int32)[None], by.astype(np.int32)[None], rows.astype(np.int32)]), np.ones(rows.shape[1], np.int64))
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        out = [(int(rows[0, s]), names.dictionary, *_packed(rows[1:, s:e], counts[s:e], rare)[1:]) for s, e in zip(starts, np.append(starts[1:], rows.shape[1]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1].to_pylist() for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["bucket", "names", "size", "data"])

    def run(batches):
        known, order, held, rows = pa.array(common, pa.string()), sorted(common), [], 0
        for batch in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            line, each = _each(batch, lambda words: _codes(words, known, order), most, NONE)
            held.append((batch.column(0).take(pa.array(line)), each))
            rows += len(line)
            if rows >= ROWS:
                yield from packed(held)
                held, rows = [], 0
        if rows:
            yield from packed(held)

    return lines(functions, most, by).mapInArrow(run, "bucket int, names array<string>, size long, data binary")


def counted(packed: DataFrame, most: int, told, schema: str) -> DataFrame:
    """What told(names, rows, counts) makes of each bucket's distinct rows in order: rows is (1 + most, rows), its group's place in names and the codes."""

    def whole(held):
        names = pa.array([x for n, _, _ in held for x in n], pa.string()).dictionary_encode()
        at, parts, counts = 0, [], []
        for n, rows, c in held:
            rows[0] = names.indices.to_numpy()[at : at + len(n)][rows[0].astype(np.int64)]
            at += len(n)
            parts.append(rows)
            counts.append(c)
        return told(names.dictionary.to_pylist(), *_distinct(np.concatenate(parts, axis=1), np.concatenate(counts)))

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, names, size, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and held:
                    yield from whole(held)
                    held = []
                now = bucket
                held.append((names, *_unpacked(data, size, most)))
        if held:
            yield from whole(held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def prefixes(rows: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each group's n-grams begin in ordered rows, and their counts; beginnings of fewer words are left out."""
    starts = np.flatnonzero(np.concatenate([[True], (rows[: n + 1, 1:] != rows[: n + 1, :-1]).any(axis=0)]))
    c, full = np.add.reduceat(counts, starts), rows[n, starts] != NONE
    return starts[full], c[full]


def spectrum(functions: DataFrame, most: int, by: str | None = "binary") -> DataFrame:
    """[by], n, count, times: how many n-grams of 1 to most words are found count times. As ngram_counts, without the n-grams."""
    name = F.col(by) if by else F.lit("")
    from .clones import written

    words = written(word_counts(functions, name), "words")
    common = common_words(words)
    buckets = max(8, 4 * functions.rdd.getNumPartitions())

    def told(names, rows, counts):
        out = []
        for n in range(2, most + 1):
            starts, c = prefixes(rows, counts, n)
            pairs, times = np.unique(np.stack([rows[0, starts].astype(np.int64), c]), axis=1, return_counts=True)
            out += [(names[g], n, k, t) for g, k, t in zip(*pairs.tolist(), times.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["by", "n", "count", "times"])

    rest = counted(blocks(functions, most, name, common, buckets), most, told, "by string, n int, count long, times long")
    every = words.groupBy("by", F.lit(1).alias("n"), "count").agg(F.count("*").alias("times")).union(rest).groupBy("by", "n", "count").agg(F.sum("times").alias("times"))
    return every.withColumnRenamed("by", by) if by else every.drop("by")


def _foremost(counts: np.ndarray, codes: np.ndarray, top: int, rank: np.ndarray) -> np.ndarray:
    """Which of the n-grams can be among the first top by falling count and words: those, and ties that rare words leave open. codes is (n, n-grams); rank: a common word's place in order."""
    if len(counts) <= top:
        return np.arange(len(counts))
    last = np.partition(counts, -top)[-top]
    sure, ties = np.flatnonzero(counts > last), np.flatnonzero(counts == last)
    short = codes[:, ties] < COMMON
    place = np.where(short, 2 * rank[np.where(short, codes[:, ties], 0).astype(np.int64)] + 1, 2 * ((codes[:, ties] >> np.uint64(HASHED)).astype(np.int64) - 1))
    # rare words between the same common ones are not in order, nor is what follows them
    place[1:][~np.logical_and.accumulate(short, axis=0)[:-1]] = 0
    order = np.lexsort(place[::-1])
    cut = place[:, order[top - len(sure) - 1]]
    below, level = np.zeros(len(ties), bool), np.ones(len(ties), bool)
    for row, x in zip(place, cut, strict=True):
        below |= level & (row < x)
        level &= row == x
    return np.concatenate([sure, ties[below | level]])


def top_ngrams(functions: DataFrame, sizes: tuple[int, ...], top: int, short: int = COMMON) -> list[tuple[int, str]]:
    """(n, ngram): of each size the top n-grams of the corpus by falling count, then by their words. Counts are exact; each task names its own foremost ones. short: words with a short code."""
    from .clones import written

    most = max(sizes)
    words = written(word_counts(functions, F.lit("")), "words")
    common = common_words(words, short)
    buckets = max(8, 4 * functions.rdd.getNumPartitions())
    rank = np.empty(max(1, len(common)), np.int64)
    rank[np.argsort(np.array(common, object))] = np.arange(len(common))
    names = ["n", "count", "codes"]

    def rows_of(n, counts, codes):
        each = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(counts) + 1, n), pa.int32()), pa.array(codes.T.astype(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), n, np.int32)), pa.array(counts.astype(np.int64)), each], names)

    def told(_, rows, counts):
        for n in sizes:
            starts, c = prefixes(rows, counts, n)
            few = _foremost(c, rows[1 : n + 1, starts], top, rank)
            yield rows_of(n, c[few], rows[1 : n + 1, starts[few]])

    def foremost(batches):
        best = {n: (np.zeros(0, np.int64), np.zeros((n, 0), np.uint64)) for n in sizes}
        for batch in batches:
            sizes_of = batch.column(0).to_numpy()
            for n in np.unique(sizes_of).tolist():
                part = batch.filter(pa.array(sizes_of == n))
                c = np.concatenate([best[n][0], part.column(1).to_numpy()])
                codes = np.concatenate([best[n][1], part.column(2).flatten().to_numpy().reshape(-1, n).T.astype(np.uint64)], axis=1)
                few = _foremost(c, codes, top, rank)
                best[n] = c[few], codes[:, few]
        for n, (c, codes) in best.items():
            yield rows_of(n, c, codes)

    def spelt(batches):
        known, order = pa.array(common, pa.string()), sorted(common)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_codes(batch.column(0), known, order).astype(np.int64)), batch.column(0)], ["code", "word"])

    schema = "n int, count long, codes array<long>"
    found = written(counted(blocks(functions, most, F.lit(""), common, buckets), most, told, schema).mapInArrow(foremost, schema), "foremost")
    spelling = words.select("word").mapInArrow(spelt, "code long, word string")
    out = []
    for n in sizes:
        own = found.where(F.col("n") == n)
        least = own.orderBy(F.desc("count")).limit(top).agg(F.min("count")).first()[0]
        if least is None:
            continue
        each = own.where(F.col("count") >= least).select("count", "codes", F.posexplode("codes").alias("i", "code")).join(spelling, "code")
        named = each.groupBy("count", "codes").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "word"))).getField("word"), " ").alias("ngram"))
        out += [(n, r.ngram) for r in named.orderBy(F.desc("count"), "ngram").limit(top).collect()]
    return out


def counts_of(functions: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
    """binary, n, ngram, count: as ngram_counts, of the wanted (n, ngram) alone. They are sent to all tasks; counts are added up in each."""
    spark, most = functions.sparkSession, max((n for n, _ in wanted), default=1)
    known = sorted({w for _, g in wanted for w in g.split(" ")})
    code = {w: i + 1 for i, w in enumerate(known)}
    # a level for each word: (state before, word) by state; a state ends an n-gram or is only on the way to one
    steps: list[dict[tuple[int, int], int]] = [{} for _ in range(most)]
    ends: list[dict[int, int]] = [{} for _ in range(most)]
    for i, (n, g) in enumerate(wanted):
        state = 0
        for level, w in enumerate(g.split(" ")):
            state = steps[level].setdefault((state, code[w]), len(steps[level]) + 1)
        ends[n - 1][state] = i
    width, levels = len(known) + 1, []
    for level, end in zip(steps, ends, strict=True):
        keys = np.array([s * width + w for s, w in level], np.int64)
        order = np.argsort(keys)
        states = np.array(list(level.values()), np.int64)[order]
        levels.append((keys[order], states, np.array([end.get(s, -1) for s in states.tolist()], np.int64)))
    sent = spark.sparkContext.broadcast((known, levels))

    def run(batches):
        known, levels = sent.value
        known, groups, held, rows = pa.array(known, pa.string()), {}, [], 0
        many = max(1, len(wanted))
        added = lambda: (lambda k, c: (np.unique(k, return_inverse=True), c))(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        for batch in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            line, each = _each(batch, lambda words: pc.fill_null(pc.index_in(words, known), -1).to_numpy().astype(np.int64) + 1, most, 0)
            group = np.array([groups.setdefault(b, len(groups)) for b in batch.column(0).to_pylist()], np.int64)[line]
            state = np.zeros(len(line), np.int64)
            for level, (keys, states, end) in enumerate(levels):
                if not len(keys):
                    break
                key = state * width + each[level]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = keys[at] == key
                at, group, state, each = at[on], group[on], states[at[on]], each[:, on]
                whole = end[at] >= 0
                held.append((group[whole] * many + end[at[whole]], np.ones(int(whole.sum()), np.int64)))
                rows += len(held[-1][0])
            if rows >= ROWS:
                (k, place), c = added()
                held = [(k, np.bincount(place, weights=c).astype(np.int64))]
                rows = len(k) // 2
        if held:
            (k, place), c = added()
            names = list(groups)
            c = np.bincount(place, weights=c, minlength=len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(k // many)), pa.array(k % many), pa.array(c)], ["binary", "wanted", "count"])

    rows = lines(functions, most, F.col("binary")).mapInArrow(run, "binary string, wanted long, count long").groupBy("binary", "wanted").agg(F.sum("count").alias("count"))
    spelt = spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(wanted)], "wanted long, n int, ngram string")
    return rows.join(F.broadcast(spelt), "wanted").select("binary", "n", "ngram", "count")
