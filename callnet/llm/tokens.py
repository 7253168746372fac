"""Token ids of whole texts by a public word-level BPE tokenizer file, many documents at once.

The tokenizer drops white space and its pre-tokens never hold any, so a text's ids are those of its blank-separated words,
one after the other. Words of ASCII and Latin-1 letters, digits and ASCII marks are cut into pre-tokens here (runs of letters,
single digits, runs of marks) and merged by `bpe.ManyWords`, each distinct one once per block. All other words (other scripts,
apostrophes, special tokens) go whole to the tokenizer library. The result is the library's, id by id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from callnet.llm.bpe import ManyWords, spread
from callnet.llm.wordhash import BLOCK, byte_blocks, mix, polynomials

#: Bytes from which on a word goes to the library, whose merging takes n log n steps.
LONG_WORD = 2000
#: Words whose ids a worker keeps, about 40 bytes each; beyond that it starts anew.
KNOWN_WORDS = 500_000

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _ODD
_CLASS[[ord("'"), ord("|")]] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class BatchTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._many = ManyWords(path)
        self._known = self._nothing()

    def _plain(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has); hashes: sorted. Known words are looked up, the others learned."""
        known, offset, count, ids = self._known
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        new = known[at] != hashes if len(known) else np.ones(len(hashes), dtype=bool)
        if new.any():
            if len(known) + new.sum() > KNOWN_WORDS:
                known, offset, count, ids = self._nothing()
                new[:] = True
            more, counts = self._many.encode(data, start[new], end[new])
            place = np.searchsorted(known, hashes[new])
            offset = np.insert(offset, place, len(ids) + np.cumsum(counts) - counts)
            count, known = np.insert(count, place, counts), np.insert(known, place, hashes[new])
            ids = np.concatenate([ids, more])
            self._known = known, offset, count, ids
            at = np.searchsorted(known, hashes)
        return ids, offset[at], count[at]

    @staticmethod
    def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a block, one after the other; where each document's begin)."""
        n = len(data)
        low, kind = _LOWER[data], _CLASS[data]
        # letters from U+00C0 to U+00FF: C3 and one byte more; all but the signs for times and division
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[data[lead + 1] < 0x9F] + 1
        low[upper] += 0x20
        head = np.zeros(n + 1, dtype=bool)
        head[offsets] = True
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            space = kind == _SPACE
            edge = head[:-1].copy()
            edge[1:] |= space[1:] != space[:-1]
            edge[0] = True
            run = np.flatnonzero(edge)
            which = np.unique(np.searchsorted(run, odd, side="right") - 1)
            stop = np.append(run[1:], n)[which]
            inside = spread(run[which], stop - run[which])
            kind[inside] = _ODD
            low[inside] = data[inside]
        first = head[:-1].copy()
        first[0] = True
        first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        real = kind[start] != _SPACE
        start, end = start[real], end[real]
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        # length and kind are mixed on their own: added to the polynomial they would make keys of neighbouring bytes equal
        h = mix(polynomials(low, start, end) ^ mix(((end - start).astype(np.uint64) << np.uint64(3)) | kind[start]))
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        strange = (kind[start[at]] == _ODD) | (end[at] - start[at] > LONG_WORD)
        plain = np.flatnonzero(~strange)
        size = np.zeros(len(at), dtype=np.int64)
        where = np.zeros(len(at), dtype=np.int64)
        ids, where[plain], size[plain] = self._plain(distinct[plain], low, start[at[plain]], end[at[plain]])
        if strange.any():
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[at[strange]].tolist(), end[at[strange]].tolist(), strict=True)]
            got = [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size[strange] = [len(x) for x in got]
            where[strange] = len(ids) + np.cumsum(size[strange]) - size[strange]
            ids = np.concatenate([ids, np.fromiter((i for x in got for i in x), dtype=np.uint32)])
        per_word = size[back]
        before = np.append(0, np.cumsum(per_word))
        return ids[spread(where[back], per_word)], before[np.searchsorted(start, offsets)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        for first, last, data, offsets in byte_blocks(column):
            if not len(data):
                yield from (np.empty(0, np.uint32) for _ in range(last - first))
                continue
            if last == first + 1 and len(data) > 2 * BLOCK:
                yield np.concatenate([self._block(x, np.array([0, len(x)]))[0] for x in _stretches(data)])
                continue
            ids, bounds = self._block(data, offsets)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield ids[a:b]


def _stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in parts of about `BLOCK` bytes that end at blanks; ids go on over a blank as if it weren't there."""
    blanks = np.flatnonzero(_CLASS[data] == _SPACE)
    at = 0
    while at < len(data):
        k = int(np.searchsorted(blanks, at + BLOCK))
        stop = int(blanks[k]) + 1 if k < len(blanks) else len(data)
        yield data[at:stop]
        at = stop


_loaded: dict[str, BatchTokenizer] = {}


def tokenizer(path: str) -> BatchTokenizer:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = BatchTokenizer(path)
    return _loaded[path]
