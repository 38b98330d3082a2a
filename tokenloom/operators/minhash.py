"""MinHash of sequences in Arrow batches: MD5 of all shingles side by side, least hashes, marks of bands."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

PRIME = 4294967291  # the largest prime below 2**32
#: Bytes of a mark: 64 bits and 32 more.
MARK = 12
_K = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SPAN, _HASHES, _ONE_BLOCK = 4096, 512, 55
#: By a message's length: which of 64 bytes are its own.
_OWN = np.where(np.arange(64) < np.arange(_ONE_BLOCK + 1)[:, None], 255, 0).astype(np.uint8)


def _md5_of_blocks(m: np.ndarray) -> np.ndarray:
    """The first 32 bits, read as in hexadecimal, of MD5 of padded messages of one block: m is (16, messages)."""
    start = [np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        s = _TURNS[i // 16][i % 4]
        f += a
        f += _K[i]
        f += m[g]
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + start[0]).byteswap()


def _md5(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """32 bits of the MD5 of each text[start : start + length]; text has 64 bytes more at its end."""
    out, windows = np.empty(len(start), np.uint32), np.lib.stride_tricks.sliding_window_view(text, 64)
    for i in range(0, len(start), _SPAN):
        s, n = start[i : i + _SPAN], length[i : i + _SPAN]
        short = np.minimum(n, _ONE_BLOCK)
        block = windows[s] & _OWN[short]
        block[np.arange(len(s)), short] = 128
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = short * 8
        out[i : i + _SPAN] = _md5_of_blocks(words)
    for i in np.flatnonzero(length > _ONE_BLOCK).tolist():
        out[i] = int.from_bytes(hashlib.md5(text[start[i] : start[i] + length[i]].tobytes(), usedforsecurity=False).digest()[:4])
    return out


class Sequences:
    """The rows of a column of string arrays, as one text with a blank after each word."""

    def __init__(self, column: pa.Array):
        words = column.flatten().cast(pa.large_string())
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        ends = np.cumsum(np.array([len(x) for x in column], np.int64)) if len(column) else np.zeros(0, np.int64)
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.length = np.diff(off)
        self.at = off[:-1] - off[0] + np.arange(len(words))
        self.text = np.full(len(data) + len(words) + 64, 32, np.uint8)
        self.text[np.arange(len(data)) + np.repeat(np.arange(len(words)), self.length)] = data

    def whole(self, row: int) -> bytes:
        """128 bits of the row: equal rows, and no others, have equal ones."""
        s, e = int(self.starts[row]), int(self.ends[row])
        text = self.text[self.at[s] : self.at[e - 1] + self.length[e - 1]] if e > s else self.text[:0]
        return hashlib.md5(text.tobytes() + self.length[s:e].tobytes(), usedforsecurity=False).digest()

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """32 bits of the MD5 of each k-gram, and its row."""
        row = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        first = np.flatnonzero(np.arange(len(row)) + k <= self.ends[row])
        last = first + k - 1
        return _md5(self.text, self.at[first], self.at[last] + self.length[last] - self.at[first]), row[first]


def least(h: np.ndarray, row: np.ndarray, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, permutations): the least (h a + b) mod PRIME of each row. row ascends. 2**32 is 5 modulo PRIME, so a product is folded instead of divided."""
    out = np.full((rows, len(a)), PRIME, np.uint64)
    a, b, prime = a.astype(np.uint64)[:, None], b.astype(np.uint64)[:, None], np.uint64(PRIME)
    x, y = np.empty((2, len(a), _HASHES), np.uint64)
    for i in range(0, len(h), _HASHES):
        part, r = h[i : i + _HASHES].astype(np.uint64), row[i : i + _HASHES]
        u, v = x[:, : len(part)], y[:, : len(part)]
        np.multiply(a, part, out=u)
        u += b
        np.right_shift(u, np.uint64(32), out=v)
        v *= np.uint64(5)
        u &= np.uint64(2**32 - 1)
        u += v  # below 2.3 times 2**32
        for _ in range(2):  # what is below the prime wraps around and is not the lesser
            np.subtract(u, prime, out=v)
            np.minimum(u, v, out=u)
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        ids = r[starts]
        out[ids] = np.minimum(out[ids], np.minimum.reduceat(u, starts, axis=1).T)
    return out


def mark(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()
