"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. The words (the tokenizer's pre-tokens) of all texts are counted.
2. The most frequent ones, LEXICON_WORDS of them at most (a fixed bound), are
   merged once and compiled, in sorted order, into a minimal acyclic automaton
   with shared prefixes and suffixes. Each arc carries the number of words that
   come before it, so that a walk along a word sums up to the word's number,
   which leads to its ids: outputs that need no place in the states.
3. The automaton is one file that each executor gets a copy of and its Python
   workers memory-map: its pages are shared and read on demand. So is the
   vocabulary, with its merges. A worker keeps nothing else from batch to batch.
4. Texts are taken in batches of BATCH_BYTES (4 MB). The distinct words of a batch walk
   through the automaton side by side, a byte of each at a time; those that it does
   not hold are merged exactly, by rank, side by side as well.

Defined results: null and empty texts have no tokens; null ids pass through;
repeated rows are encoded one by one; an empty table gives an empty table; a text
longer than a batch is a batch of its own. The text of an added special token in a
text is that token, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, bounded, materialise, slices, table, tidy

#: Words in the lexicon, at most.
LEXICON_WORDS = 65_536
#: Counted words that a task holds before it hands them on.
COUNTED = 600_000
#: Words of more bytes than this are merged one by one, with a heap.
LONG_WORD = 64

#: Fixed: the pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = (1 << 64) - 1
LOW = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _begins(sizes: np.ndarray) -> np.ndarray:
    """Where each of some rows begins that lie one after another, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _spread(begins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places of all entries of some rows, in the order of the rows."""
    sizes = begins[rows + 1] - begins[rows]
    ends = np.cumsum(sizes)
    return np.repeat(begins[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), _begins(np.array([len(w) for w in words], np.int64))


def _strings(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins."""
    _, offsets, data = words.buffers()
    begins = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), begins


def _mapped(path: str) -> mmap.mmap:
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _file_of(arrays: list[np.ndarray]) -> bytes:
    """Their number and sizes, then each, at a multiple of eight bytes."""
    head = struct.pack(f"<{len(arrays) + 1}Q", len(arrays), *(a.nbytes for a in arrays))
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


def _arrays_of(data, kinds: list[str]) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<Q", data)
    at, out = 8 * (n + 1), []
    for size, kind in zip(struct.unpack_from(f"<{n}Q", data, 8), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size + -size % 8
    return out


class Merger:
    """Exact BPE by merge rank, and decoding: arrays of a vocabulary file, or of a mapped copy of them."""

    KINDS = ["<u8", "<u8", "<u4", "<i8", "u1", "u1"]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = data["model"]["vocab"]
        pairs: dict[int, int] = {}  # left << 32 | right: rank << 32 | merged
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        keys = sorted(pairs)
        at = _begins(np.array([len(t) for t in tokens]))
        told = np.frombuffer(json.dumps(special).encode(), np.uint8)
        self._take([np.array(keys, "<u8"), np.array([pairs[k] for k in keys], "<u8"), np.array([vocab[c] for c in letters], "<u4"), at, np.frombuffer(b"".join(tokens), np.uint8), told])

    @classmethod
    def mapped(cls, path: str) -> Merger:
        out = cls.__new__(cls)
        out._take(_arrays_of(_mapped(path), cls.KINDS))
        return out

    def file(self) -> bytes:
        return _file_of([self.keys, self.made, self.byte_ids, self.at, self.data, self.told])

    def _take(self, arrays: list[np.ndarray]) -> None:
        self.keys, self.made, self.byte_ids, self.at, self.data, self.told = arrays
        self.special: dict[str, int] = json.loads(self.told.tobytes())
        whole = self.data.tobytes()
        self.token_bytes = [whole[a:b] for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pair(self, left: int, right: int) -> int:
        """rank << 32 | merged, or NEVER."""
        key = left << 32 | right
        i = bisect_left(self.keys, key)
        return int(self.made[i]) if i < len(self.keys) and self.keys[i] == key else NEVER

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As pair(), of many."""
        if not len(self.keys):
            return np.full(len(left), NEVER, np.uint64)
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.made[i], np.uint64(NEVER))

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by rank and then from the left, from a heap of neighbouring pairs: n log n for n bytes."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        found = self.pairs(np.array(ids[:-1], np.uint64), np.array(ids[1:], np.uint64)).tolist()
        heap = [(x >> 32, i, ids[i], ids[i + 1], x & LOW) for i, x in enumerate(found) if x != NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := self.pair(ids[a], ids[b])) != NEVER:
                    heapq.heappush(heap, (x >> 32, a, ids[a], ids[b], x & LOW))
        return [x for x in ids if x >= 0]

    def merge_all(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, and where those of each begin. In a round each word makes its merge of the least rank, the leftmost of equal ones."""
        sizes = np.diff(begins)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            found = self.merge(data[begins[i] : begins[i + 1]].tobytes())
            out.append((np.full(len(found), i), np.array(found, np.uint32)))
        mine = np.flatnonzero((sizes <= LONG_WORD) & (sizes > 0))
        owner = np.repeat(mine, sizes[mine])
        ids = self.byte_ids[data[_spread(begins, mine)]]
        last = np.append(np.diff(owner) != 0, True) if len(owner) else np.zeros(0, bool)
        rank = np.full(len(ids), NEVER, np.uint64)
        if len(ids):
            inner = np.flatnonzero(~last)
            rank[inner] = self.pairs(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            each = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            done = least == np.uint64(NEVER)
            if done.any():
                gone = np.repeat(done, each)
                out.append((owner[gone], ids[gone]))
                owner, ids, rank = owner[~gone], ids[~gone], rank[~gone]
                if not len(ids):
                    break
                least, each = least[~done], each[~done]
                starts = _begins(each)[:-1]
            hits = np.flatnonzero(rank == np.repeat(least, each))
            hits = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]  # a word's first
            ids[hits] = (least & np.uint64(LOW)).astype(np.uint32)
            rank[hits] = rank[hits + 1]  # whether anything follows the pair's right part
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # places once the right parts are gone: one went for each word before
            owner, ids, rank = owner[keep], ids[keep], rank[keep]
            ends = np.append(owner[1:] != owner[:-1], True)
            begun = np.concatenate(([True], ends[:-1]))
            rank[at] = NEVER
            right, left = at[~ends[at]], at[~begun[at]] - 1
            rank[right] = self.pairs(ids[right], ids[right + 1])
            rank[left] = self.pairs(ids[left], ids[left + 1])
        owner, ids = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.int64, [x[0] for x in out]), (np.uint32, [x[1] for x in out])))
        order = np.argsort(owner, kind="stable")
        return ids[order], _begins(np.bincount(owner, minlength=len(sizes)))

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special tokens, each with the id of the token that follows it."""
        at = 0
        if self.specials is not None:
            for m in self.specials.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def build_automaton(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Sorted distinct words to the bytes of a minimal acyclic automaton.

    A state is frozen once no later word can pass through it; equal frozen states
    are one state. Layout: the root, each arc as its source and byte (ascending),
    its target and the words before it, each state's finality, the words' ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[tuple[list[tuple[int, int]], list[bool]]] = [([], [False])]  # of the last word: arcs that are frozen, whether a word ends
    labels: list[int] = []

    def freeze(state: tuple[list, list[bool]]) -> int:
        key = (state[1][0], tuple(state[0]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    def shorten(to: int) -> None:
        while len(path) > to + 1:
            target = freeze(path.pop())
            path[-1][0].append((labels.pop(), target))

    for word in words:
        common = 0
        while common < min(len(word), len(labels)) and word[common] == labels[common]:
            common += 1
        shorten(common)
        for b in word[common:]:
            labels.append(b)
            path.append(([], [False]))
        path[-1][1][0] = True
    shorten(0)
    root = freeze(path[0])
    below: list[int] = []  # words at and below each state; targets are frozen before their sources
    arcs, targets, skips = [], [], []
    for state, (final, out) in enumerate(states):
        skip = int(final)
        for b, t in out:
            arcs.append(state << 8 | b)
            targets.append(t)
            skips.append(skip)
            skip += below[t]
        below.append(skip)
    finals = np.array([f for f, _ in states], "u1")
    return _file_of([np.array([root], "<i8"), np.array(arcs, "<i8"), np.array(targets, "<u4"), np.array(skips, "<u4"), finals, _begins(np.array([len(x) for x in ids], np.int64)), np.array([i for x in ids for i in x], "<u4")])


class Lexicon:
    """A memory-mapped automaton: words to ids."""

    def __init__(self, path: str):
        root, self.arcs, self.targets, self.skips, self.finals, self.begins, self.ids = _arrays_of(_mapped(path), ["<i8", "<i8", "<u4", "<u4", "u1", "<i8", "<u4"])
        self.root = int(root[0])

    def numbers(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that the automaton does not hold. All words go on by a byte at a time."""
        sizes = np.diff(begins)
        number, state = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.root, np.int64)
        live, step = np.flatnonzero(sizes > 0), 0
        while len(live):
            key = state[live] << 8 | data[begins[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            state[live[~found]] = -1
            live, arc = live[found], arc[found]
            number[live] += self.skips[arc]
            state[live] = self.targets[arc]
            step += 1
            live = live[sizes[live] > step]
        return np.where((state >= 0) & (self.finals[np.maximum(state, 0)] > 0), number, -1)

    def get(self, word: bytes) -> list[int] | None:
        (number,) = self.numbers(*_joined([word]))
        return None if number < 0 else self.ids[self.begins[number] : self.begins[number + 1]].tolist()


class Cut:
    """Texts without special tokens, cut into words: the distinct words; the words of each distinct chunk; the chunks of the texts.

    Texts are cut before blanks. A word holds a blank at its front at most, and white
    space looks at what follows only where a run of it ends; so a cut is safe where
    the character before the blank is not white space, and the words of what lies
    between safe cuts depend on that alone.
    """

    def __init__(self, texts: pa.StringArray, words: regex.Pattern):
        pieces = pc.split_pattern(texts, " ")
        firsts = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        which, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        alpha = np.fromiter(map(str.isalpha, known), bool, len(known))
        tight = alpha.copy()
        for i in np.flatnonzero(~alpha).tolist():
            tight[i] = known[i] != "" and not known[i][-1].isspace()
        first = np.zeros(len(which), bool)
        first[firsts[:-1]] = True  # each text has a piece, if an empty one
        start = first.copy()
        start[1:] |= tight[which[:-1]]
        begins = np.flatnonzero(start)
        sizes = np.diff(np.append(begins, len(which)))
        self.text_begins = np.searchsorted(begins, firsts)
        # chunks of one piece behind a blank, cut from their neighbours on both sides, need no more than the piece
        plain = (sizes == 1) & ~first[begins] & tight[which[begins]]
        numbers: dict[str, int] = {}
        chunk = which[begins]
        for i in np.flatnonzero(~plain).tolist():
            a, n = begins[i], sizes[i]
            said = ("" if first[a] else " ") + (known[which[a]] if n == 1 else " ".join([known[p] for p in which[a : a + n].tolist()]))
            chunk[i] = len(known) + numbers.setdefault(said, len(numbers))
        used = np.zeros(len(known), bool)
        used[chunk[plain]] = True
        alone, mixed = np.flatnonzero(used & alpha).tolist(), np.flatnonzero(used & ~alpha).tolist()
        found = words.findall(" " + " ".join([known[i] for i in mixed])) if mixed else []
        fronts = np.flatnonzero(np.array([w[0] == " " for w in found], bool))
        others = [words.findall(said) for said in numbers]
        counts = np.zeros(len(known) + len(numbers), np.int64)
        counts[alone] = 1
        counts[mixed] = np.diff(np.append(fronts, len(found)))
        counts[len(known) :] = [len(x) for x in others]
        flat = [" " + known[i] for i in alone] + found + [w for x in others for w in x]
        # the words came in the order alone, mixed, others: back to that of the chunks' numbers
        order = np.concatenate([np.array(alone, np.int64), np.array(mixed, np.int64), np.arange(len(known), len(counts))])
        came = np.zeros(len(counts) + 1, np.int64)
        came[order] = _begins(counts[order])[:-1]
        coded = pa.array(flat, pa.string()).dictionary_encode()
        self.words: pa.StringArray = coded.dictionary
        places = np.repeat(came[:-1] - _begins(counts)[:-1], counts) + np.arange(counts.sum())
        self.chunk_words, self.chunk_begins = coded.indices.to_numpy().astype(np.int64)[places], _begins(counts)
        self.chunks = chunk

    def counts(self) -> np.ndarray:
        """How often each distinct word occurs."""
        often = np.bincount(self.chunks, minlength=len(self.chunk_begins) - 1)
        return np.bincount(self.chunk_words, weights=np.repeat(often, np.diff(self.chunk_begins)), minlength=len(self.words)).astype(np.int64)


class Coder:
    """Encodes and decodes: lexicon first, exact merging for the rest."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None):
        self.merger, self.lexicon = merger, lexicon
        digits = len(str(len(merger.token_bytes)))
        self.decimal = np.array([f"{i}," for i in range(len(merger.token_bytes))], f"S{digits + 1}")

    def word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where those of each begin."""
        data, begins = _strings(words)
        if self.lexicon is None:
            return self.merger.merge_all(data, begins)
        number = self.lexicon.numbers(data, begins)
        new = np.flatnonzero(number < 0)
        merged, merged_at = self.merger.merge_all(data[_spread(begins, new)], _begins(np.diff(begins)[new]))
        # rows of the lexicon's ids, then those merged here
        rows = number.copy()
        rows[new] = len(self.lexicon.begins) - 1 + np.arange(len(new))
        held = np.concatenate((self.lexicon.begins, len(self.lexicon.ids) + merged_at[1:]))
        sizes = held[rows + 1] - held[rows]
        out, at = np.empty(sizes.sum(), np.uint32), _begins(sizes)
        old = np.flatnonzero(number >= 0)
        out[_spread(at, old)] = self.lexicon.ids[_spread(self.lexicon.begins, number[old])]
        out[_spread(at, new)] = merged
        return out, at

    def encode_all(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text."""
        held = [t for t in self.merger.special if pc.any(pc.match_substring(texts, t)).as_py()] if len(texts) else []
        if held:
            parts = [list(self.merger.parts(t)) for t in texts.to_pylist()]
            ids = iter(self._encode(pa.array([p for x in parts for p, _ in x], pa.string())))
            return [np.concatenate([y for _, s in x for y in (next(ids), np.array([] if s is None else [s], np.uint32))]) for x in parts]
        return self._encode(texts)

    def _encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        cut = Cut(texts, self.merger.words)
        ids, at = self.word_ids(cut.words)
        ids, sizes = ids[_spread(at, cut.chunk_words)], np.diff(at)[cut.chunk_words]
        at = _begins(sizes)[cut.chunk_begins]  # of the distinct chunks
        out, ends = ids[_spread(at, cut.chunks)], _begins(np.diff(at)[cut.chunks])[cut.text_begins]
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def said(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimal[ids].tobytes().replace(b"\0", b"")[:-1]


_SENT: dict[tuple, str] = {}


def _send(spark: SparkSession, data: bytes, label: str) -> str:
    """Give a file to all executors, also to those that start later. Its name for SparkFiles."""
    name = f"{label}-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(os.path.abspath(path))
    return name


def send_vocabulary(spark: SparkSession, vocabulary: str) -> str:
    """The name of the file of a vocabulary's arrays; sent once for each application."""
    key = (spark.sparkContext.applicationId, vocabulary, os.stat(vocabulary).st_mtime_ns)
    if key not in _SENT:
        _SENT[key] = _send(spark, Merger(vocabulary).file(), "vocabulary")
    return _SENT[key]


_OPEN: dict[str, object] = {}


def _opened(kind, name: str):
    """A mapped file of this worker, by the name that SparkFiles knows."""
    if name not in _OPEN:
        if len(_OPEN) >= 4:
            _OPEN.clear()
        _OPEN[name] = kind(SparkFiles.get(name))
    return _OPEN[name]


def word_counts(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """word, n over all texts. Each task adds up the words of its batches, and hands them on when they are COUNTED."""
    sent = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _opened(Merger.mapped, sent)
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for part in slices(batches, 0):
            cut = Cut(part.column(0).drop_null(), merger.words)
            held.append(pa.table([cut.words, pa.array(cut.counts())], ["word", "n"]))
            if sum(t.num_rows for t in held) > COUNTED:
                held[:] = [summed()]
                if held[0].num_rows > COUNTED // 2:
                    yield from held.pop().to_batches(100_000)
        if held:
            yield from summed().to_batches(100_000)

    return docs.select(F.col(text_column).cast("string")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS, text_column: str = "text") -> str | None:
    """Compile the words that occur most often and give the file to all executors. Its name, or None without words."""
    counts = materialise(word_counts(docs, vocabulary, text_column).where("n > 1"), "word-counts")
    # The least count that at most size words reach, to an eighth of a power of two: what is collected has size rows at most in all.
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    room, least = size, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # some hundred rows
        if r.words > room:
            break
        room, least = room - r.words, r.level
    rows = counts.where(level >= least).select("word").collect() if least is not None else []
    words = sorted({r.word.encode("utf-8", "surrogatepass") for r in rows})
    if not words:
        return None
    ids, at = Merger(vocabulary).merge_all(*_joined(words))
    return _send(docs.sparkSession, build_automaton(words, [x.tolist() for x in np.split(ids, at[1:-1])]), "lexicon")


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids, decoded (the text that the ids give back); with digests: doc_id, n_tokens, ids_sha256, decoded_sha256 in their place."""
    sent = send_vocabulary(docs.sparkSession, vocabulary)
    docs = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(rest).fields])
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_opened(Merger.mapped, sent), _opened(Lexicon, lexicon) if lexicon else None)
        for part in slices(batches, 1):
            rows = []
            for ids in coder.encode_all(part.column(1)):
                back = coder.merger.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(coder.said(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) if digests else (ids.astype(np.int32), back))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], schema.names)

    return docs.mapInArrow(tidy(run), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), default_vocabulary()
    return encode(docs, vocabulary, build_lexicon(docs, vocabulary), digests=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, n_tokens and the digests of each document's ids and of what they decode to."""
    bounded(spark)
    vocabulary = default_vocabulary()
    return encode(docs, vocabulary, build_lexicon(docs, vocabulary), digests=True)


__all__ = ["Coder", "Lexicon", "Merger", "build_automaton", "build_lexicon", "encode", "op2", "stage", "word_counts"]
