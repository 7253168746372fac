"""Words of whole texts as 64-bit hashes, for many documents at once (numpy over Arrow buffers).

Two definitions of a word: "blank" words are maximal runs of `[^\\x20\\x09-\\x0D]`; "alnum" words are maximal runs of
ASCII letters, digits and bytes from 0x80 up. A-Z is lower-cased first, nothing else is changed. Hashes are the same in every process.

Work goes block by block: a block holds whole documents, about `BLOCK` bytes, more only if a single document is longer. Arrays of several
bytes per byte of text are made for stretches of `BLOCK` bytes at a time, so a very long text takes little more than its size and its words'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 512 << 10
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[48:58] = _NOT_ALNUM[65:91] = _NOT_ALNUM[97:123] = _NOT_ALNUM[128:] = False
GAPS = {"blank": _BLANK, "alnum": _NOT_ALNUM}

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64; n: how many are needed, `BLOCK` at most."""
    if not _powers:
        for base in (_P, _P_INV):
            x = np.full(BLOCK, base, dtype=np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a byte counts in a polynomial.
_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)


def _polynomial(data: np.ndarray, value: np.ndarray) -> int:
    """The sum of value[byte] * base ** position of one word of any length."""
    total = 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += int((value[part] * powers(len(part))[0]).sum(dtype=np.uint64)) * pow(_P, at, 1 << 64)
    return total % (1 << 64)


def polynomials(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = _PLUS_ONE) -> np.ndarray:
    """The polynomial hash of each word data[start:end]; words are in order and don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + BLOCK, side="right"))
        if j <= i:
            out[i] = _polynomial(data[base : end[i]], value)
            i += 1
            continue
        a, b = start[i:j] - base, end[i:j] - base
        n = int(b[-1])
        power, inverse = powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value[data[base : base + n]] * power, out=total[1:])
        out[i:j] = (total[b] - total[a]) * inverse[a]
        i = j
    return out


@dataclass
class Block:
    """Documents [first, last) of a batch. Word i has hash[i] and bytes [start[i], end[i]) of data; document d has the words [words[d], words[d + 1])."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.words))


def byte_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    values = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, values[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_blocks(column: pa.Array, words: str = "blank") -> Iterator[Block]:
    gap = GAPS[words]
    for first, last, data, offsets in byte_blocks(column):
        n = len(data)
        if not n:
            e = np.empty(0, np.int64)
            yield Block(first, last, data, offsets, e.astype(np.uint64), e, e, np.zeros(last - first + 1, np.int64))
            continue
        inside = ~gap[data]
        head = np.zeros(n + 1, dtype=bool)
        head[offsets] = True  # a word never crosses from a document to the next
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | head[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | head[1:])) + 1
        low = _LOWER[data]
        h = mix(polynomials(low, start, end) + (end - start).astype(np.uint64))
        yield Block(first, last, low, offsets, h, start, end, np.searchsorted(start, offsets))


def part_hashes(block: Block, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, ascending, the hash of the first `size` bytes of each word (of the whole word if it is shorter)."""
    total, found = np.zeros(len(block.start), dtype=np.uint64), []
    length = block.end - block.start
    for j in range(max(sizes)):
        on = np.flatnonzero(length > j)
        total[on] += _PLUS_ONE[block.data[block.start[on] + j]] * np.uint64(pow(_P, j, 1 << 64))
        if j + 1 in sizes:
            found.append(mix(total + np.uint64(0x51ED27 + j)))
    return found


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from word i on, i) for each i whose k words lie in one document."""
    n = len(block.hash)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = block.hash[: n - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + block.hash[j : n - k + 1 + j]
    doc = block.doc_of_word()
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    return mix(out[at]), at


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words, of any length."""
    out = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            out = np.uint64(out * np.uint64(0xD6E8FEB86659FD93) + w)
    return mix(np.array([out ^ np.uint64(0xA5A5A5A5)], dtype=np.uint64))[0]


def shingle_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, nothing."""
    h, at = shingles(block, k)
    bounds = np.searchsorted(at, block.words)
    for d in range(block.last - block.first):
        a, b = bounds[d], bounds[d + 1]
        if b > a:
            yield np.unique(h[a:b])
        elif block.words[d + 1] > block.words[d]:
            yield np.array([sequence_hash(block.hash[block.words[d] : block.words[d + 1]])], dtype=np.uint64)
        else:
            yield np.empty(0, np.uint64)
