"""Vectorised word kernel shared by the text operators.

A word is a maximal run of bytes outside space and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``), so
multi-byte characters never split.  Everything here works on one slice of an Arrow string column at
a time: the slice's bytes stay in one buffer, words are index ranges into it, and every word gets a
64-bit hash.  Slices hold a bounded number of bytes, except that one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text handled at once; temporaries take about twenty times as much.
SLICE_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of a slice of texts.

    ``buf`` bytes, ``first`` index of each text's first word (n + 1 entries), ``start``/``end`` byte
    ranges, ``hash`` per word, ``null`` per text.  With ``letters``, words are runs of ASCII letters,
    digits and bytes of other scripts instead.
    """

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        n = len(column)
        self.n = n
        self.null = np.asarray(column.is_null())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        if lower:
            raw = _LOWER[raw]
        self.buf = raw
        self._gap = _NOT_LETTER if letters else _SPACE
        self._split()

    def _split(self) -> None:
        size = len(self.buf)
        if not size:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(self.n + 1, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        inside = ~self._gap[self.buf]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < size]
        begin[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[edges] = inside[edges]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        """Polynomial over a random byte table, then mixed with the length."""
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        at = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=at[1:])
        powers = np.full(int(length.max()), _ODD, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        place = np.arange(int(at[-1] + length[-1]), dtype=np.int64)
        place -= np.repeat(at, length)
        value = powers[place]
        value *= _TABLE[self.buf[inside]]
        total = np.add.reduceat(value, at)
        return mix64(total ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def prefix(self, k: int) -> np.ndarray:
        """The first k bytes of each word (k <= 7) with k in the low byte; 0 for words that are not longer."""
        at = np.minimum(self.start[:, None] + np.arange(k), max(0, len(self.buf) - 1))
        packed = np.full(len(self.start), k, np.uint64)
        for j in range(k):
            packed |= self.buf[at[:, j]].astype(np.uint64) << np.uint64(8 * (j + 1))
        packed[self.end - self.start <= k] = 0
        return packed

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(self.n), self.counts)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of k consecutive word hashes, at each place where k follow (across texts too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64((0xA0761D6478BD642F * (2 * k + 1) + seed * 0xE7037ED1A0B428DB) & (2**64 - 1)), np.uint64)
    for j in range(k):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += h[j : j + n] ^ np.uint64((0x8EBC6AF09C88C6E3 * (j + 1)) & (2**64 - 1))
        out ^= out >> np.uint64(29)
    return mix64(out)


def gram_places(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at which a k-gram lies inside one text, and that text."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    return np.arange(int(n.sum()), dtype=np.int64) - at[owner] + first[:-1][owner], owner


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted: (hashes, bounds with n + 1 entries).

    A text with 1 to k - 1 words has its whole sequence as one shingle; without words, none.
    """
    places, owner = gram_places(words.first, k)
    h = grams(words.hash, k)[places] if len(places) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.array([grams(words.hash[words.first[i] : words.first[i + 1]], int(words.counts[i]), seed=1)[0] for i in short], np.uint64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
        back = np.argsort(owner, kind="stable")
        h, owner = h[back], owner[back]
    bounds = np.searchsorted(owner, np.arange(words.n + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.zeros(words.n + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=sizes[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's texts stay near the limit; a longer text is a part of its own."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(size)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
