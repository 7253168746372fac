"""Byte-pair merging of many words at once, from the vocabulary and the merges of a tokenizer file.

For words of one pre-token, already normalized and lower-cased. The lowest-ranked pair of each word is merged, the leftmost one
on ties, until no pair of the word is in the merges: the usual definition, done on a matrix with one row per word.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(1 << 30)


def _byte_symbols() -> list[str]:
    """The printable character that byte-level BPE vocabularies write for each byte: itself if it's visible in Latin-1, else from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


class ManyWords:
    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = _byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self._last = np.array([vocab[s + model["end_of_word_suffix"]] for s in symbols], dtype=np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        self._merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self._bits = 19
        self._keys = np.full(1 << self._bits, -1, dtype=np.int64)
        self._ranks = np.full(1 << self._bits, _NONE, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing; of those that want one free slot the first gets it
            free = self._keys[slot[todo]] == -1
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self._keys[slot[put]] = keys[put]
            self._ranks[slot[put]] = put
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & (len(self._keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, dtype=np.int32)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            found = self._keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self._ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            slot[todo] = (slot[todo] + 1) & (len(self._keys) - 1)
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; how many each has) of the words data[start:end]."""
        sizes = end - start
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(sizes), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            least = int(sizes[order[at]])
            stop = min(len(order), at + max(1, 600_000 // max(1, least)))
            stop = max(at + 1, at + int(np.searchsorted(sizes[order[at:stop]], least * 1.25 + 2, side="right")))  # little padding
            part = order[at:stop]
            ids, counts[part] = self._encode(data, start[part], sizes[part])
            parts.append((part, ids))
            at = stop
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        for part, ids in parts:
            out[spread(offset[part], counts[part])] = ids
        return out, counts

    def _encode(self, data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(start), int(sizes.max())
        filled = np.arange(width) < sizes[:, None]
        s = np.full((n, width), -1, dtype=np.int32)
        s[filled] = self._inner[data[spread(start, sizes)]]
        rows = np.arange(n)
        s[rows, sizes - 1] = self._last[data[start + sizes - 1]]
        done = np.full((n, width), -1, dtype=np.int32)
        ranks = np.full((n, width), _NONE, dtype=np.int32)
        if width > 1:
            ranks[:, :-1] = self._rank(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), j]
            ended = best == _NONE
            if ended.any():
                done[rows[ended], : s.shape[1]] = s[ended]
                on = ~ended
                rows, s, ranks, j, best = rows[on], s[on], ranks[on], j[on], best[on]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            s[here, j] = self._merged[best]
            shift = np.arange(s.shape[1] - 1) + (np.arange(s.shape[1] - 1) > j[:, None])
            s, ranks = np.take_along_axis(s, shift, 1), np.take_along_axis(ranks, shift, 1)
            w = s.shape[1]
            following = np.where(j + 1 < w, s[here, np.minimum(j + 1, w - 1)], -1)
            ranks[here, j] = self._rank(s[here, j], following)
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self._rank(s[left, j[left] - 1], s[left, j[left]])
        keep = done >= 0
        return done[keep].astype(np.uint32), keep.sum(axis=1)
