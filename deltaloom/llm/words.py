"""Words of Arrow text columns and their hashes, in numpy, without a Python object for each word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is the same as a
run of such code points in UTF-8. Words of up to LONG bytes are hashed by eight
bytes at a time, longer ones by BLAKE2b; successive words by combining hashes of
halves. Each step is a bijection of either input but not linear, so that no
rule of how words are made up or repeated gives equal hashes. Two families of
constants are independent.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Also ASCII punctuation parts words.
PLAIN = np.zeros(256, bool)
PLAIN[:128] = [not chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER = _LOWER.astype(np.uint8)
#: Bytes of a word that are hashed in numpy.
LONG = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = [(0xD1342543DE82EF95, 0x9FB21C651E98DF25), (0xF1357AEA2E62A9C5, 0xAEF17502108EF2D9)]
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _join(a: np.ndarray, b: np.ndarray, family: int) -> np.ndarray:
    """A hash of the pair (a, b)."""
    x = a * np.uint64(_ODD[family][0])
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(_ODD[family][1])
    x ^= x >> np.uint64(29)
    return x


def give_back() -> None:
    """Return freed memory to the system: workers stay, and share the executor's limit with other stages' workers."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


@dataclass
class Words:
    """The words of the texts lo to hi of a column."""

    lo: int
    hi: int
    data: np.ndarray
    text_at: np.ndarray  # bytes: where each text begins, and the end
    starts: np.ndarray  # bytes: of words
    ends: np.ndarray
    word_at: np.ndarray  # words: where each text's begin, and the end

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text in this chunk."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.text_at[i] : self.text_at[i + 1]].tobytes()

    def hashes(self, family: int = 0, lower: bool = False) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        size = self.ends - self.starts
        whole = np.zeros(len(data) // 8 + 2, np.uint64)
        whole.view(np.uint8)[: len(data)] = data
        h = size.astype(np.uint64) + np.uint64(1)
        some, begin, left = slice(None), self.starts, size
        for _ in range(LONG // 8):
            # eight bytes from any place, of two that lie at multiples of eight
            at, shift = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
            piece = (whole[at] >> shift) | ((whole[at + 1] << np.uint64(1)) << (np.uint64(63) - shift))
            h[some] = _join(h[some], piece & _MASK[np.minimum(left, 8)], family)
            more = np.flatnonzero(size > 8) if isinstance(some, slice) else some[left > 8]
            if not len(more):
                break
            begin, left = (begin[left > 8] + 8, left[left > 8] - 8)
            some = more
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(data[self.starts[i] : self.ends[i]], digest_size=8, key=b"%d" % family).digest(), "little")
        return mix(h)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.word_at[1:], self.counts()) - np.arange(self.word_at[-1])


def grams(hashes: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hashes of k successive words at each place where so many follow in the chunk."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, hashes, 1
    while done < k:
        # power: of width words, a power of two; out: of the first done words
        if k & width:
            out = power[:n] if out is None else _join(out, power[done : done + n], family)
            done += width
        if done < k:
            power, width = _join(power[:-width], power[width:], family), 2 * width
    return mix(out)


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets


def split(array: pa.Array, apart: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a text column, some texts at a time. apart: the bytes between words."""
    data, offsets = columns(array)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        text_at = offsets[lo : hi + 1] - offsets[lo]
        word = ~apart[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[text_at] = True
        before, after = np.empty(len(part), bool), np.empty(len(part), bool)
        if len(part):
            before[0] = after[-1] = True
            before[1:], after[:-1] = ~word[:-1], ~word[1:]
        starts = np.flatnonzero(word & (before | edge[:-1]))
        ends = np.flatnonzero(word & (after | edge[1:])) + 1
        yield Words(lo, hi, part, text_at, starts, ends, np.searchsorted(starts, text_at))
        lo = hi
    give_back()
