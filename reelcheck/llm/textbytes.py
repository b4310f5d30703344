"""Words of whole Arrow string columns as numpy arrays, straight from their UTF-8 bytes.

Word characters are given as a table over byte values; every byte of a character beyond ASCII has the
same class, so that classes of code points and of bytes agree.  A word's identity is a 64-bit hash of
its lower-cased bytes.  A column is worked on in pieces of bounded size, so memory does not follow the
length of a text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once (their arrays fit in a core's cache).
PIECE = 1 << 15
MULTIPLIER = 0x9E3779B97F4A7C15


def byte_class(inside: str) -> np.ndarray:
    """A table over byte values: ``space`` for all but ASCII white space, ``alnum`` for letters, digits and beyond ASCII."""
    table = np.ones(256, bool)
    if inside == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
        table[0x41:0x5B] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes the words of a string column. Holds the tables, about 50 MB."""

    def __init__(self, inside: str):
        self.inside = byte_class(inside)
        self.lower = lower_table()
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))[self.lower]  # a capital's is that of its letter
        self.power = self.inverse = np.ones(0, np.uint64)
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        """Powers of the multiplier and of its inverse modulo 2**64."""
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            self.power = np.cumprod(np.full(n, MULTIPLIER, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64))

    def piece(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of the words in raw; no word runs over a place in breaks."""
        inside = self.inside[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        breaks = breaks[breaks < len(raw)]
        first[breaks] = inside[breaks]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = breaks[breaks > 0] - 1
        last[before] = inside[before]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        self.grow(len(raw))
        own = self.value[raw]
        own *= self.power[: len(raw)]
        before_own = own[start]
        total = np.cumsum(own, out=own)
        low = total[start] - before_own
        return mixed((total[end] - low) * self.inverse[start]), start, end + 1

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of a string column, and the text (its row) of each. Nulls have none."""
        return self.words(texts, False)[:2]

    def words(self, texts: pa.Array, leads: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As column(), and the first two bytes of each word."""
        data, offsets = text_bytes(texts)
        hashes, lead, n_before = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], np.zeros(len(offsets), np.int64)
        at, stop, n = int(offsets[0]), int(offsets[-1]), 0
        while at < stop:
            to = self.cut(data, at, stop, offsets)
            i, j = np.searchsorted(offsets, at), np.searchsorted(offsets, to)
            raw = data[at:to]
            h, start, end = self.piece(raw, offsets[i:j] - at)
            hashes.append(h)
            n_before[i:j] = n + np.searchsorted(start, offsets[i:j] - at)
            n += len(h)
            if leads:
                lead.append(self.lower[raw[start]].astype(np.uint16) * 256 + self.lower[raw[np.minimum(start + 1, end - 1)]])
            at = to
        n_before[np.searchsorted(offsets, stop) :] = n
        return np.concatenate(hashes), np.repeat(np.arange(len(offsets) - 1), np.diff(n_before)), np.concatenate(lead)

    def cut(self, data: np.ndarray, at: int, stop: int, offsets: np.ndarray) -> int:
        """Where the next piece ends: at a place where no word goes on."""
        to = at + PIECE
        if to >= stop:
            return stop
        texts_end = offsets[np.searchsorted(offsets, to)]
        while to < texts_end and self.inside[data[to]]:
            to += 1
        return to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets; a null is as long as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting (``np.unique`` without indices hashes, which takes longer for numbers like these)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def runs(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the n rows in a sorted list of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def trim() -> None:
    """Gives freed memory back to the system, which the C library of Linux else keeps for the process."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


class Lookup:
    """Places of 64-bit keys in a table: one probe for most, a binary search for those whose slot another key has."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.mask = np.uint64((1 << max(10, int(4 * max(1, len(keys))).bit_length())) - 1)
        at = (self.keys & self.mask).astype(np.int64)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.zeros(int(self.mask) + 1, bool)
        self.shared[at[self.slots[at] != np.arange(len(keys))]] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each in the sorted keys, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = (h & self.mask).astype(np.int64)
        place = self.slots[at].astype(np.int64)
        wrong = (place >= 0) & (self.keys[place] != h)
        retry = np.flatnonzero(wrong & self.shared[at])
        place[wrong] = -1
        if len(retry):
            p = np.minimum(np.searchsorted(self.keys, h[retry]), len(self.keys) - 1)
            place[retry] = np.where(self.keys[p] == h[retry], p, -1)
        return place
