"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Words are white-space tokens in lower case; shingles are five of them (a shorter
text is one shingle). The weight of a shingle in a text is tf * idf with
idf = 1 + DAMPING * ln((1+N)/(1+df)) / ln(1+N): damped, as the shingles of a text
with many near copies are frequent by those copies alone, and must still weigh
against its rare ones. Similarity is the weighted Jaccard sum(min)/sum(max).

1. Texts with the same words are one; its smallest doc_id represents them.
2. Document frequencies: each task sorts its shingles' hashes, counts them by
   document, and sends packed runs of them to buckets of the hash space, whose
   number follows the corpus. A bucket finds which shingles two or more documents
   share; shingles that are frequent in a chunk come as counts. Only these go on: a shingle of one document matches nothing.
3. Sampling (Ioffe 2010), SAMPLES times a document. A sample's value is
   exponential in the weight, so the least value over all of a document's own
   shingles is drawn at once, from the sum of their weights.
4. BANDS bands of ROWS samples; a band's pivot is its most central text, whose
   shingles are the most frequent ones. The other texts of a band are compared with
   its pivot alone, by weighted Jaccard, and linked at THRESHOLD or more. A text
   that is not similar to its pivot is similar to another text of the band only if
   the two share enough of their differences from the pivot; a prefix filter on
   these differences finds such pairs (see compare()), so no candidate link between
   two components is lost, and no band is paired in full.
5. Classes are the components; the smallest doc_id of one names it.

Defined results: a null text is an empty one; texts without words are copies of
each other; a null doc_id is below all others and is reported as null; rows that
repeat a doc_id give one row each, and are linked by their texts; an empty table
gives an empty table. At a similarity of 0.8 the chance that no band of a pair
agrees is (1 - 0.8**ROWS)**BANDS, about 2e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh, give_back, id_of, key_of, materialise, mix, pack, pack_sorted, sum_of, table, tidy, unpack, unpack_sorted

SHINGLE = 5
THRESHOLD = 0.8
DAMPING = 0.25
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
#: Shingles are 56-bit hashes.
HASH_BITS = 56
BUCKET_SHINGLES = 1_000_000
LEAST_BUCKETS = 96
#: Words that a task holds at a time.
CHUNK_WORDS = 1_000_000
#: A shingle in so many texts of a chunk is hot.
HOT = 32


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def node_of(words: list[str]) -> int:
    """A text's number: 128 bits of its words."""
    return xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return (x & (2**64 - 1)) - 2**63


def text_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """key, sum (of the text as it is), high and node (the hash of its words), n_words; a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, n = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                h = node_of(words)
                high.append(_signed(h >> 64))
                low.append(_signed(h))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (high, low, n))], ["key", "sum", "high", "node", "n_words"])

    return docs.select(key_of(id_column).alias("key"), sum_of(text_column), text_column).mapInArrow(tidy(run), "key long, sum long, high long, node long, n_words long")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, shingle hash) pairs of some texts, given by their words' hashes, by hash, and how often each occurs."""
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *texts])
    whole = np.repeat(sizes, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the text's end
    starts = np.flatnonzero((left >= SHINGLE) | (left == whole) & (whole < SHINGLE))
    del whole
    owner, left = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[starts], left[starts]
    value = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(SHINGLE):
        mixed = mix(value ^ flat[np.minimum(starts + i, max(len(flat) - 1, 0))]) + np.uint64(i + 1)
        value = np.where(left > i, mixed, value)
    del flat, left, starts
    value = mix(value) >> np.uint64(64 - HASH_BITS)
    order = np.argsort(value, kind="stable")  # owners ascend, so they do within a hash
    value, owner = value[order], owner[order].astype(np.int64)
    if not len(value):
        return owner, value, value.astype(np.int64)
    new = np.concatenate(([True], (np.diff(value) != 0) | (np.diff(owner) != 0)))
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.concatenate((at, [len(value)])))


def _packed(place: np.ndarray, places: int, ids: np.ndarray, value: np.ndarray, rest: list[np.ndarray]) -> tuple[list[int], list[list[bytes]]]:
    """Entries, ordered by place, as a blob for each place: its documents, each entry's document, hashes, and the rest."""
    at = np.searchsorted(place, np.arange(places + 1))
    found, out = [], []
    for p in np.flatnonzero(np.diff(at)):
        part = slice(at[p], at[p + 1])
        mine, where = np.unique(ids[part], return_inverse=True)
        found.append(int(p))
        out.append([pack_sorted(mine), pack(where), pack(value[part]), *(pack(x[part]) for x in rest)])
    return found, out


def _send(buckets: int):
    """Texts to blobs for buckets of the hash space: shingles, documents and counts.

    A shingle that HOT or more documents of a chunk hold goes to its bucket as a
    count only; its entries go to buckets beyond those of the hash space, dealt out
    by document, so none gathers a shingle that a third of all documents hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()

        def blobs() -> pa.RecordBatch:
            order = sorted(nodes)
            ids = np.array(order, np.uint64)
            owner, value, tf = shingles([nodes[i] for i in order])
            nodes.clear()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(value)) + 1)) if len(value) else np.zeros(0, np.int64)
            local = np.diff(np.concatenate((starts, [len(value)])))
            hot = np.repeat(local >= HOT, local)
            bucket = ((value >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            out_bucket, out = _packed(bucket[~hot], buckets, ids[owner[~hot]], value[~hot], [tf[~hot]])
            nothing = [pack(np.zeros(0, np.uint64))] * 2
            rows = {b: [*x, *nothing] for b, x in zip(out_bucket, out, strict=True)}
            hot_value, hot_count = value[starts[local >= HOT]], local[local >= HOT]
            hot_bucket = bucket[starts[local >= HOT]]
            for b in np.unique(hot_bucket).tolist():
                mine = hot_bucket == b
                rows[b] = [*rows.get(b, [nothing[0]] * 4)[:4], pack(hot_value[mine]), pack(hot_count[mine])]
            if hot.any():
                ids_hot = ids[owner[hot]]
                place = (mix(ids_hot) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                for b, x in zip(*_packed(place[order], buckets, ids_hot[order], value[hot][order], [tf[hot][order]]), strict=True):
                    rows[buckets + b] = [*x, *nothing]
            columns = list(zip(*rows.values(), strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], SENT_COLUMNS)

        nodes: dict[int, np.ndarray] = {}
        words = 0
        for batch in batches:
            for text in batch.column(0):
                found = words_of(text.as_py())
                nodes.setdefault(node_of(found) & (2**64 - 1), hashes.of(found))
                words += len(found)
                if words > CHUNK_WORDS:
                    yield blobs()
                    words = 0
        if nodes:
            yield blobs()

    return tidy(run)


SENT_COLUMNS = ["bucket", "ids", "docs", "hashes", "tf", "hot_hashes", "hot_counts"]
SENT_SCHEMA = "bucket int, ids binary, docs binary, hashes binary, tf binary, hot_hashes binary, hot_counts binary"


def _shared(buckets: int):
    """The blobs of a bucket to blobs for groups of documents: the shingles that two or more documents hold, with their document frequencies.

    A frequency of zero stands for one that another bucket tells, in the columns hot_hashes and hot_df, to every group.
    """

    def run(part: pa.Table) -> pa.Table:
        here = part.column("bucket")[0].as_py()
        blobs = list(zip(*(part.column(c).to_pylist() for c in SENT_COLUMNS[1:]), strict=True))
        ids = np.concatenate([unpack_sorted(x[0])[unpack(x[1]).astype(np.int64)] for x in blobs])
        value, tf, hot_hashes, hot_counts = (np.concatenate([unpack(x[i]) for x in blobs]) for i in (2, 3, 4, 5))
        order = np.lexsort((ids, value))
        ids, value, tf = ids[order], value[order], tf[order]
        if len(value):  # a text that came twice
            new = np.concatenate(([True], (np.diff(value) != 0) | (np.diff(ids) != 0)))
            ids, value, tf = ids[new], value[new], tf[new]
        hot, inverse = np.unique(hot_hashes, return_inverse=True)
        hot_df = np.bincount(inverse, weights=hot_counts.astype(np.float64), minlength=len(hot)).astype(np.uint64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(value)) + 1)) if len(value) else np.zeros(0, np.int64)
        each = np.diff(np.concatenate((starts, [len(value)])))
        df = each.astype(np.uint64)
        if len(hot) and len(value):
            at = np.minimum(np.searchsorted(hot, value[starts]), len(hot) - 1)
            df = df + np.where(hot[at] == value[starts], hot_df[at], np.uint64(0))
        if len(hot):  # all documents that hold it, in this bucket or in the others
            at = np.searchsorted(value[starts], hot) if len(value) else np.zeros(len(hot), np.int64)
            inside = np.minimum(at, max(len(starts) - 1, 0))
            if len(value):
                hot_df = np.where(value[starts][inside] == hot, df[inside], hot_df)
        df = np.repeat(df, each)
        if here >= buckets:
            df[:] = 0
        else:
            ids, value, tf, df = (x[df > 1] for x in (ids, value, tf, df))
        group = (mix(ids) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((value, ids, group))
        ids, value, tf, df, group = (x[order] for x in (ids, value, tf, df, group))
        nothing = pack(np.zeros(0, np.uint64))
        out_group, out = _packed(group, buckets, ids, value, [tf, df])
        rows = [[g, *x, nothing, nothing] for g, x in zip(out_group, out, strict=True)]
        if len(hot):
            told = [pack(hot), pack(hot_df)]
            rows += [[g, nothing, nothing, nothing, nothing, nothing, *told] for g in range(buckets)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        give_back()
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=SHARED_COLUMNS)

    return run


SHARED_COLUMNS = ["group", "ids", "docs", "hashes", "tf", "df", "hot_hashes", "hot_df"]
SHARED_SCHEMA = "group int, ids binary, docs binary, hashes binary, tf binary, df binary, hot_hashes binary, hot_df binary"


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + DAMPING * np.log((1 + n) / (1 + np.minimum(df, n))) / math.log(1 + n)


def _uniform(h: np.ndarray, sample: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform draws in (0, 1) that depend on the shingle and the sample alone."""
    bits = mix(h + np.uint64((sample * 4 + which + 1) * 0x9E3779B97F4A7C15 % 2**64))
    scale = np.float32(2.0**-24)
    return ((bits >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale, ((bits >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale


def sample_bands(ids: np.ndarray, starts: np.ndarray, value: np.ndarray, weight: np.ndarray, alone: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """For each band, a hash for each document; zero where a sample is a shingle of that document alone, which matches nothing.

    ids: one for each document; starts: where its shared shingles begin in value and weight; alone: the weights of its own shingles, summed.
    """
    logs = np.log(weight).astype(np.float32)
    seeds = mix(value)
    docs = np.arange(len(starts))
    owner = np.repeat(docs, np.diff(np.concatenate((starts, [len(value)]))))
    out = []
    with np.errstate(over="ignore", divide="ignore"):
        for band in range(bands):
            key = np.full(len(ids), band + 1, np.uint64)
            valid = np.ones(len(ids), bool)
            for sample in range(band * rows, (band + 1) * rows):
                u1, u2 = _uniform(seeds, sample, 0)
                u3, u4 = _uniform(seeds, sample, 1)
                beta, _ = _uniform(seeds, sample, 2)
                r = -np.log(u1 * u2)
                t = np.floor(logs / r + beta)
                ln_a = np.log(-np.log(u3 * u4)) - r * (t - beta) - r
                least = np.minimum.reduceat(ln_a, starts)
                hit = np.flatnonzero(ln_a == least[owner])
                first = np.full(len(ids), -1)
                first[owner[hit][::-1]] = hit[::-1]  # ties: the smallest hash
                mine, _ = _uniform(mix(ids ^ np.uint64(0xA5A5A5A5A5A5A5A5)), sample, 3)
                valid &= least < np.log(-np.log(mine) / alone)
                key = mix(key ^ mix(value[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            out.append(np.where(valid, key | np.uint64(1), np.uint64(0)))
    return out


def _sample(n_docs: int):
    """The blobs of a group of documents and its documents' sizes to (node, total weight, packed shared shingles, bands)."""

    def run(group, shared: pa.Table, sizes: pa.Table) -> pa.Table:
        blobs = list(zip(*(shared.column(c).to_pylist() for c in SHARED_COLUMNS[1:]), strict=True))
        none = [np.zeros(0, np.uint64)]
        ids = np.concatenate([unpack_sorted(x[0])[unpack(x[1]).astype(np.int64)] for x in blobs] + none)
        if not len(ids):
            return SIGNED.empty_table()
        value, tf, df, hot, hot_df = (np.concatenate([unpack(x[i]) for x in blobs]) for i in (2, 3, 4, 5, 6))
        order = np.argsort(hot)
        hot, hot_df = hot[order], hot_df[order]
        open_ = df == 0
        df[open_] = hot_df[np.searchsorted(hot, value[open_])]
        order = np.lexsort((value, ids))
        ids, value, tf, df = (x[order] for x in (ids, value, tf, df))
        new = np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(value) != 0)))
        ids, value, tf, df = (x[new] for x in (ids, value, tf, df))
        weight = tf.astype(np.float64) * idf(df.astype(np.float64), n_docs)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
        docs = ids[starts]
        words = dict(zip(sizes.column("node").to_pylist(), sizes.column("n_words").to_pylist(), strict=True))
        nodes = [_signed(int(x)) for x in docs]
        count = np.array([max(1, words[x] - SHINGLE + 1) for x in nodes], np.float64)
        alone = np.maximum(count - np.add.reduceat(tf.astype(np.float64), starts), 0) * idf(np.array([1.0]), n_docs)[0]
        total = alone + np.add.reduceat(weight, starts)
        central = np.round(np.add.reduceat(tf * np.log(df.astype(np.float64)), starts) / count, 9)  # high where many hold most of a text
        bands = np.stack(sample_bands(docs, starts, value, weight, alone), axis=1)
        ends = np.concatenate((starts[1:], [len(ids)]))
        packed = [[f(x[a:z]) for a, z in zip(starts, ends, strict=True)] for f, x in ((pack_sorted, value), (pack, tf), (pack, df))]
        lists = [[int(x) for x in row if x] for row in bands.astype(np.int64)]
        give_back()
        return pa.table([pa.array(nodes, pa.int64()), pa.array(total), *(pa.array(x, pa.binary()) for x in packed), pa.array(central), pa.array(lists, pa.list_(pa.int64()))], schema=SIGNED)

    return run


SIGNED = pa.schema([("node", pa.int64()), ("total", pa.float64()), ("hashes", pa.binary()), ("tf", pa.binary()), ("df", pa.binary()), ("central", pa.float64()), ("bands", pa.list_(pa.int64()))])
SIGNED_SCHEMA = "node long, total double, hashes binary, tf binary, df binary, central double, bands array<long>"


def signatures(docs: DataFrame, groups: DataFrame, n_docs: int, n_words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each distinct text that shares a shingle with another one. groups: key of a row that has the text, node, n_words."""
    buckets = max(LEAST_BUCKETS, -(-n_words // BUCKET_SHINGLES))
    own = docs.select(key_of(id_column).alias("key"), F.col(text_column).alias("text"))
    texts = own.join(groups.select("key").hint("shuffle_hash"), "key", "left_semi").select("text")
    sent = texts.mapInArrow(_send(buckets), SENT_SCHEMA)
    shared = sent.groupBy("bucket").applyInArrow(_shared(buckets), SHARED_SCHEMA)
    sizes = groups.where("n_words > 0").select("node", "n_words").mapInArrow(_with_group(buckets), "group int, node long, n_words long")
    return shared.groupBy("group").cogroup(sizes.groupBy("group")).applyInArrow(_sample(n_docs), SIGNED_SCHEMA)


def _with_group(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(2**63)
            group = (mix(node) % np.uint64(groups)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(0), batch.column(1)], ["group", "node", "n_words"])

    return run


def compare(p: tuple, m: tuple, threshold: float = THRESHOLD) -> tuple[bool, float, float, float, float, list[dict]]:
    """Whether a pivot p and a member m are similar; |p|, A, the part of A that other texts can share, D; and the prefix of m's differences from p that partners of m must meet.

    A text is (total weight, hashes ascending, weights, document frequencies). With D
    the weights that m lacks of p and A those that it has beyond p, the intersection
    of two members x and y is |p| - D(x) - D(y) + s and the union |p| + A(x) + A(y) - s,
    where s is the weight of the differences that they share. So if y is not similar
    to p, a partner x of y shares differences with it: as much as need below, of
    either's. Differences are ordered, rare ones first; two texts that share that
    much share an element before the point from which on less than need is left.
    Nor can s be more than the smaller of the two texts' A and D, or than what is
    left of either's differences from the first shared one on: see partners().
    """
    total_p, hashes_p, weights_p, df_p = p
    total_m, hashes_m, weights_m, df_m = m
    every = np.union1d(hashes_p, hashes_m)
    wp, wm, df = np.zeros(len(every)), np.zeros(len(every)), np.zeros(len(every))
    at_p, at_m = np.searchsorted(every, hashes_p), np.searchsorted(every, hashes_m)
    wp[at_p], wm[at_m] = weights_p, weights_m
    df[at_p], df[at_m] = df_p, df_m
    alone_p, alone_m = max(0.0, total_p - weights_p.sum()), max(0.0, total_m - weights_m.sum())
    change = wm - wp
    more, less = np.maximum(change, 0), np.maximum(-change, 0)
    added, lacking = more.sum() + alone_m, less.sum() + alone_p
    similar = total_p - lacking >= threshold * (total_p + added) * (1 - 1e-12)
    if similar:
        need = (threshold * added + lacking) / (1 + threshold)
    else:
        need = (threshold * (total_p + added) - total_p + lacking) / (1 + threshold)
    new, gone = np.flatnonzero(more), np.flatnonzero(less)
    new, gone = new[np.lexsort((every[new], df[new]))], gone[np.lexsort((every[gone], -df[gone]))]
    weight = np.concatenate([more[new], less[gone], [alone_p]])
    element = np.concatenate([every[new] * np.uint64(2), every[gone] * np.uint64(2) + np.uint64(1), np.zeros(1, np.uint64)])
    left = np.cumsum(weight[::-1])[::-1]  # from each element on
    prefix = left >= max(need, 1e-9) * (1 - 1e-9)
    elements = [{"element": e, "left": x} for e, x in zip(element[prefix].astype(np.int64).tolist(), left[prefix].tolist(), strict=True)]
    return bool(similar), float(total_p), float(added), float(more.sum()), float(lacking), elements


def partners(x: str, y: str, threshold: float = THRESHOLD):
    """Whether two members of a pivot can share enough of their differences from it to be similar, if none comes before the element at hand."""
    c = lambda name, of: F.col(f"{of}.{name}")
    most = F.least(c("common", x), c("common", y)) + F.least(c("lacking", x), c("lacking", y))
    lacking = c("lacking", x) + c("lacking", y)
    need = (threshold * (c("size", x) + c("added", x) + c("added", y)) - c("size", x) + lacking) / (1 + threshold)
    return F.least(most, c("left", x), c("left", y)) >= need - 1e-9


def compared(pairs: DataFrame, signed: DataFrame, n_docs: int) -> DataFrame:
    """a, b and what compare() tells of distinct pairs. a may be in a third of all pairs: it is joined last, by a join that Spark can split, and its shingles are not shuffled with each pair."""
    columns = ("total", "hashes", "tf", "df")
    one = lambda p: signed.select(F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    both = pairs.join(one("b").hint("merge"), "b").join(one("a").hint("merge"), "a")
    kinds = [pa.bool_(), *[pa.float64()] * 4, pa.list_(pa.struct([("element", pa.int64()), ("left", pa.float64())]))]
    names = ["a", "b", "linked", "size", "added", "common", "lacking", "elements"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple] = {}

            def got(row: int, at: int, batch=batch, known=known) -> tuple:
                node = batch.column(at)[row].as_py()
                if node not in known:
                    if len(known) > 1000:
                        known.clear()
                    total, hashes, tf, df = (batch.column(2 + 4 * at + i)[row].as_py() for i in range(4))
                    df = unpack(df).astype(np.float64)
                    known[node] = (total, unpack_sorted(hashes), unpack(tf).astype(np.float64) * idf(df, n_docs), df)
                return known[node]

            rows = [compare(got(i, 0), got(i, 1)) for i in range(batch.num_rows)]
            told = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names)

    return both.select("a", "b", *(f"{p}_{c}" for p in "ab" for c in columns)).mapInArrow(tidy(run), "a long, b long, linked boolean, size double, added double, common double, lacking double, elements array<struct<element:long,left:double>>")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of links: neighbours' labels, then labels' labels, until nothing changes."""
    both = materialise(links.union(links.select("b", "a")).distinct(), "links")
    now = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = now.join(near, "node").select("node", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        jump = now.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = materialise(step.join(jump, "to").select("node", F.least("to", "next").alias("component"), "was"), "labels")
        changed = new.where("component <> was").limit(1).count()
        now = new.select("node", "component")
        if not changed:
            return now


def linked(signed: DataFrame, n_docs: int) -> DataFrame:
    """node, component of the texts that a link joins to another."""
    members = signed.select("node", "central", F.explode("bands").alias("band"))
    pivots = members.groupBy("band").agg(F.max(F.struct("central", "node")).alias("top"), F.count("*").alias("n"))
    pivots = materialise(pivots.where("n > 1").select("band", F.col("top.node").alias("pivot")), "pivots")
    first = members.join(pivots, "band").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = materialise(compared(materialise(first, "pairs"), signed, n_docs), "compared")
    links = first.where("linked").select("a", "b")
    joined = components(links)
    # texts that are not similar to their pivot, with the pivot's other texts in other components that share their differences
    sizes = ["size", "added", "common", "lacking"]
    placed = first.join(joined.select(F.col("node").alias("b"), "component"), "b", "left").select(F.col("a").alias("pivot"), "b", "linked", F.coalesce("component", "b").alias("component"), *sizes, F.inline("elements"))
    placed = materialise(placed, "differences")
    met = placed.where("not linked").alias("y").join(placed.alias("x"), (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.component") != F.col("y.component")) & partners("x", "y"))
    met = met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = compared(materialise(met.join(done, ["a", "b"], "left_anti"), "pairs"), signed, n_docs).where("linked").select("a", "b")
    late = materialise(late, "linked")
    return components(links.union(late)) if late.limit(1).count() else joined


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: key and sum (of its text), class_first and exact_first: the smallest (key, sum) of its class and of the texts with its words."""
    keys = materialise(text_keys(docs, id_column, text_column), "text-keys")
    groups = keys.groupBy("high", "node").agg(F.min(F.struct("key", "sum")).alias("first"), F.max("n_words").alias("n_words"))
    groups = materialise(groups.withColumn("key", F.col("first.key")), "texts")
    n_docs, n_words = groups.agg(F.count("*"), F.sum("n_words")).first()
    signed = materialise(signatures(docs, groups, max(1, n_docs), n_words or 0, id_column, text_column), "signatures")
    placed = linked(signed, max(1, n_docs)).join(groups.select("node", "first"), "node")
    best = placed.groupBy("component").agg(F.min("first").alias("class_first"))
    named = groups.join(placed.select("node", "component").join(best, "component").select("node", "class_first"), "node", "left")
    named = named.select("high", "node", F.col("first").alias("exact_first"), F.coalesce("class_first", "first").alias("class_first"))
    return keys.join(named, ["high", "node"]).select("key", "sum", "class_first", "exact_first")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    first = F.struct("key", "sum") == F.col("class_first")
    return found.select(id_of("key").alias("doc_id"), id_of("class_first.key").alias("class_id"), id_of("exact_first.key").alias("exact_id"), first.alias("is_representative"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays, once."""
    bounded(spark)
    key, check = fresh("__key", docs), fresh("__sum", docs)
    keep = classes(docs).where(F.struct("key", "sum") == F.col("class_first")).select(F.col("key").alias(key), F.col("sum").alias(check)).distinct()
    marked = docs.withColumns({key: key_of("doc_id"), check: sum_of("text")})
    return marked.join(keep.hint("shuffle_hash"), [key, check], "left_semi").dropDuplicates([key, check]).drop(key, check)
