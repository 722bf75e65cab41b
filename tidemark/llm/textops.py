"""Vectorised text kernels that run inside Spark tasks.

A task gathers whole texts into chunks of a few megabytes; one chunk is one byte
buffer, and all work on it is numpy over that buffer. Words are runs of bytes
other than ``\\x20`` and ``\\x09-\\x0D``. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (fills pa.compute)

U64 = np.uint64
#: Text bytes after which a chunk is closed; one longer text makes a chunk of its own.
CHUNK_BYTES = 4 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """64-bit fingerprints of words and word windows; ``seed`` picks an independent family.

    A word is hashed by tabulation: each (byte, place) has a random number of its own, so the hash is no polynomial, whose
    value modulo a power of two agrees for certain long words whatever the base. Windows are hashed as trees.
    """

    PLACES = 64  # tables; further bytes use them again, times a random odd number for each turn

    def __init__(self, seed: int = 1, lower: bool = False):
        key = U64(seed * 0x9FB21C651E98DF25 & 2**64 - 1)
        byte = np.arange(256, dtype=U64)
        if lower:  # A-Z only
            byte[65:91] += U64(32)
        place = np.arange(self.PLACES, dtype=U64)[:, None]
        table = mix(mix(byte[None, :] * U64(0x9E3779B97F4A7C15) + key) + place * U64(0xD6E8FEB86659FD93))
        table[:, _SEP] = 0
        self.table, self.key = table.ravel(), key
        self.level = [U64(int(x) | 1) for x in mix(np.arange(1, 65, dtype=U64) + key)]

    def words(self, chunk: "Chunk") -> np.ndarray:
        if not len(chunk.starts):
            return np.zeros(0, U64)
        n = len(chunk.buf)
        at = np.zeros(n, np.int32 if n < 2**31 else np.int64)
        at[chunk.starts] = chunk.starts
        np.maximum.accumulate(at, out=at)
        np.subtract(np.arange(n, dtype=at.dtype), at, out=at)
        value = self.table[((at & (self.PLACES - 1)) << 8) | chunk.buf]
        lengths = chunk.ends - chunk.starts
        if lengths.max() > self.PLACES:
            far = np.flatnonzero(at >= self.PLACES)
            value[far] *= mix((at[far] // self.PLACES).astype(U64) + self.key) | U64(1)
        return mix(np.add.reduceat(value, chunk.starts) + lengths.astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Fingerprint of the ``k`` values from each index on; joins halves, so log2(k) passes."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        out, done, part, size, level = None, 0, words, 1, 0
        while True:
            if k & size:
                piece = part[done : done + n]
                out = piece if out is None else mix(out * self.level[level] + piece)
                done += size
            if done == k:
                return out
            part = mix(part[:-size] * self.level[32 + level] + part[size:])
            size, level = 2 * size, level + 1


class Chunk:
    """Whole texts in one buffer: word bounds and, per text, the range of its words and bytes."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.byte_start = np.concatenate([[0], np.cumsum(sizes)])
        self.n_bytes = sizes - 1
        sep = _SEP[self.buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(sep) and not sep[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.word_start = np.searchsorted(self.starts, self.byte_start)
        self.n_words = np.diff(self.word_start)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts), dtype=np.int32), self.n_words)

    def window_starts(self, k: int) -> np.ndarray:
        """Indices of the words that begin a window of ``k`` words inside one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(n, bool)
        for e in self.word_start[1:-1]:
            ok[max(0, e - k + 1) : e] = False
        return np.flatnonzero(ok)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Slices of the incoming rows with about ``size`` bytes of text each, and the texts as UTF-8."""
    held, held_bytes = [], 0

    def out() -> tuple[pa.Table, list[bytes]]:
        table = pa.Table.from_batches(held)
        texts = table.column(column).cast(pa.large_binary()).to_pylist()
        return table, [t or b"" for t in texts]

    for batch in batches:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
        total, begin = np.cumsum(lengths), 0
        while begin < len(lengths):
            base = total[begin - 1] if begin else 0
            stop = int(np.searchsorted(total, base + size - held_bytes)) + 1
            part = batch.slice(begin, stop - begin)
            held.append(part)
            held_bytes += int(total[min(stop, len(total)) - 1] - base)
            begin = stop
            if held_bytes >= size:
                yield out()
                held, held_bytes = [], 0
    if held:
        yield out()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start .. start+length-1`` of every pair, one after another."""
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.zeros(0, np.int64)
    step = np.ones(int(lengths.sum()), np.int64)
    ends = np.cumsum(lengths)
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of ``n`` places that some window ``start .. start+width-1`` covers."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
