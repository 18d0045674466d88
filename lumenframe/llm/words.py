"""Words of a whole Arrow batch at once: byte masks and prefix hashes in numpy, without a Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = [0x20, *range(0x09, 0x0E)]


def _table(separators: list[int]) -> np.ndarray:
    out = np.ones(256, bool)
    out[separators] = False
    return out


#: True for the bytes of a word. Bytes from 0x80 on are parts of UTF-8 characters and belong to words in both.
SPACED = _table(_WHITE)
ALNUM = _table([b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers. Tables for a block of text are kept; those for a longer word are made for it and forgotten."""
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(2 * _BLOCK) if size <= 2 * _BLOCK else _powers.__wrapped__(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts. Each ends with one space in buf: word i is buf[start[i]:end[i]]; text d has the words docs[d]:docs[d + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    docs: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def doc_end(self) -> np.ndarray:
        """For each word the number of the first word after its text."""
        return np.repeat(self.docs[1:], self.counts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans from word first to word last, equal for equal bytes."""
        return self.span_hashes(self.start[first], self.end[last])

    def span_hashes(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """As hashes(), for byte positions; begin must ascend. Works block by block, so that one very long text costs no more memory."""
        out = np.empty(len(begin), np.uint64)
        for low in range(0, len(self.buf), _BLOCK):
            i, j = np.searchsorted(begin, [low, low + _BLOCK])
            if i == j:
                continue
            part = self.buf[low : int(stop[i:j].max())]
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            out[i:j] = mix((sums[stop[i:j] - low] - sums[begin[i:j] - low]) * down[begin[i:j] - low])
        return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one space, and their bounds. A null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
    return buf[bounds[0] : bounds[-1]] if len(bounds) else buf, bounds - bounds[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def split_words(texts: pa.Array, in_word: np.ndarray, lower: bool = False) -> Words:
    buf, bounds = text_buffer(texts)
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), empty, empty, np.zeros(len(texts) + 1, np.int64))
    if lower:
        buf = lower_ascii(buf)
    inside = in_word[buf]
    after = np.zeros(len(buf), bool)  # the separator next to a word
    np.logical_and(inside[:-1], ~inside[1:], out=after[1:])
    docs = np.searchsorted(np.flatnonzero(after), bounds)
    kept = buf[inside | after]
    kept[after[inside | after]] = 0x20
    end = np.flatnonzero(kept == 0x20)
    start = np.empty_like(end)
    start[:1] = 0
    start[1:] = end[:-1] + 1
    return Words(kept, start, end, docs)


def trim() -> None:
    """Give freed memory back to the system: a worker stays when its task is done, and several share an executor's limit."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about max_bytes; a longer text is a run of its own, and whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > max_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def windows(words: Words, size: int) -> np.ndarray:
    """The first words of all runs of size words that lie within one text."""
    at = np.arange(len(words.start))
    return at[at + size <= words.doc_end()]


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether buf[a:a + length] and buf[b:b + length] are equal, eight bytes at a time."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(pad) - 7,), "<u8", pad.data, 0, (1,))
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    done = 0
    while len(live):
        left = length[live] - done
        live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        keep = np.where(left >= 8, np.uint64(_MASK), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        equal = ((eight[a[live] + done] ^ eight[b[live] + done]) & keep) == 0
        same[live[~equal]] = False
        live = live[equal]
        done += 8
    return same
