"""License scan: winnowed template fingerprints in an inverted index, then banded alignment.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Of each template the hashes of all runs of `K` words are
winnowed: of every `WINDOW` neighbouring hashes the least is kept (Schleimer et al. 2003), so any run of K + WINDOW - 1 words that a
text shares with a template holds a kept one. The index maps a kept hash to (template, position); it depends on the templates
only and is broadcast. Of templates of fewer than `SHORT` words all runs of `SHORT_K` words that hold a decisive word are in it instead, so a notice with a changed
word is found. The hashes of all runs of each whole text are looked up. Hits of a template on
neighbouring diagonals make a candidate region; within `BAND` words of its diagonal (a quarter of a short template) a longest common
subsequence aligns template and text. A region counts if the aligned words cover `COVERAGE` of the template and, for templates of fewer than `STRICT` words, the
decisive words in it (`DECISIVE`: versions, variants, names of licenses) are those of the template in the same order: "version 2" is no version 3, and BY-NC-SA no BY-NC. Of regions that
overlap in the text the one with more aligned words stays.

Defined results: null or empty texts have no matches. Repeated rows get equal results. Templates shorter than K words are indexed as
one run. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.llm.common import read_table

K, WINDOW, BAND, COVERAGE = 4, 3, 16, 0.8
SHORT, SHORT_K, STRICT = 20, 3, 60

# Words that tell one license from another.
DECISIVE = (
    "0 1 2 3 4 affero apache boost bsd by cc cc0 eclipse general gnu isc lesser mit mozilla mpl nc nd sa unencumbered zlib"
).split()

_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_GNU = (("gpl", "General", ("2.0", "3.0")), ("lgpl", "Lesser General", ("2.1", "3.0")), ("agpl", "Affero General", ("3.0",)))
_NAMED = (("mit", "MIT"), ("isc", "ISC"), ("bsd-2-clause", "BSD 2-Clause"), ("bsd-3-clause", "BSD 3-Clause"))
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Texts of public license notices.
TEMPLATES = {
    **{f"apache-{v}-line": f"Licensed under the Apache License, Version {v}" for v in ("1.1", "2.0")},
    **{f"{k}-line": f"Released under the {name} License" for k, name in _NAMED},
    **{f"cc-{k.lower()}-{v}-line": f"Licensed under CC {k} {v}" for k in _CC for v in ("3.0", "4.0")},
    **{f"{k}-{v}-line": f"This work is licensed under the GNU {name} Public License, version {v.removesuffix('.0')}" for k, name, versions in _GNU for v in versions},
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    **{
        f"{k}-{v}-or-later": (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as "
            f"published by the Free Software Foundation, either version {v.removesuffix('.0')} of the License, or (at your option) any later version."
        )
        for k, name, versions in _GNU
        for v in versions
    },
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD_START + _BSD_END,
    "bsd-3-clause": _BSD_START + _BSD_THIRD + _BSD_END,
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    from callnet.llm.wordhash import mix

    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : n + j]
    return mix(out)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window; the last one on ties."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


class Index:
    """Fingerprint to (template, position), sorted by fingerprint; one table for each run length."""

    def __init__(self, templates: dict[str, str]):
        from callnet.llm.wordhash import word_blocks

        self.names = list(templates)
        self.words: list[np.ndarray] = []
        for block in word_blocks(pa.array(list(templates.values())), "alnum"):
            self.words += [block.hash[a:b].copy() for a, b in zip(block.words[:-1], block.words[1:], strict=True)]
        self.decisive = np.unique(next(iter(word_blocks(pa.array([" ".join(DECISIVE)]), "alnum"))).hash)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, words in enumerate(self.words):
            k = min(SHORT_K if len(words) < SHORT else K, len(words))
            if k:
                h = _runs(words, k)
                kept = winnow(h)
                if len(words) < SHORT:  # all runs that hold a decisive word; all runs at all where there is none
                    some = np.convolve(np.isin(words, self.decisive), np.ones(k, dtype=int), "valid")
                    kept = np.flatnonzero(some > 0) if some.any() else np.arange(len(h))
                found.setdefault(k, []).extend((int(h[p]), t, p) for p in kept.tolist())
        self.tables = {}
        for k, rows in found.items():
            rows.sort()
            self.tables[k] = tuple(np.array([r[i] for r in rows], dtype=np.uint64 if i == 0 else np.int64) for i in range(3))

    def agrees(self, template: np.ndarray, part: np.ndarray) -> bool:
        """Whether a part of a text has the decisive words of the template, in order; long templates are not held to that."""
        return len(template) >= STRICT or template[np.isin(template, self.decisive)].tolist() == part[np.isin(part, self.decisive)].tolist()


def band_of(size: int, band: int = BAND) -> int:
    """Short templates get a narrow band, so that neighbouring copies of a line stay apart."""
    return min(band, max(2, size // 4))


def align(template: np.ndarray, text: np.ndarray, start: int, band: int = BAND) -> tuple[int, int, int]:
    """(aligned words, first, last) of the longest common subsequence of the template and the text near the diagonal that begins at word `start`.

    Among subsequences of equal length the tightest in the text wins.
    """
    width = 2 * band + 1
    # best[o]: (words, -span, first, last) of alignments that end before text word start + i + o - band
    best: list[tuple[int, int, int, int]] = [(0, 0, -1, -1)] * (width + 1)
    for i, w in enumerate(template.tolist()):
        now: list[tuple[int, int, int, int]] = []
        for o in range(width):
            at = start + i + o - band
            up = best[o + 1] if o + 1 <= width else best[width]
            choice = max(up, now[-1]) if now else up
            if 0 <= at < len(text) and int(text[at]) == w:
                n, _, first, _ = best[o]
                first = at if first < 0 else first
                choice = max(choice, (n + 1, first - at, first, at))
            now.append(choice)
        best = [*now, now[-1]]
    n, _, first, last = max(best)
    return n, first, last


def regions(at: np.ndarray, place: np.ndarray, size: int, band: int = BAND) -> list[int]:
    """Start words of the candidate regions of a template's hits (text word, template word), one per group of near diagonals."""
    out: list[int] = []
    for d in np.sort(at - place).tolist():
        if not out or d - out[-1] > band_of(size, band) // 2:
            out.append(d)
    return out


def matches(index: Index, words: np.ndarray, hits: list[tuple[int, int, int]], coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, aligned words, first, last word) of a text's matches that don't overlap, in text order; hits: (template, text word, template word)."""
    found = []
    by: dict[int, list[tuple[int, int]]] = {}
    for t, a, p in hits:
        by.setdefault(t, []).append((a, p))
    for t, pairs in by.items():
        template = index.words[t]
        at, place = (np.array(x) for x in zip(*pairs, strict=True))
        for start in regions(at, place, len(template)):
            n, first, last = align(template, words, start, band_of(len(template)))
            if n >= coverage * len(template) and index.agrees(template, words[first : last + 1]):
                found.append((n, -t, first, last))
    out: list[tuple[int, int, int, int]] = []
    for n, t, first, last in sorted(found, key=lambda x: (-x[0], x[3] - x[2], x[2], -x[1])):
        if all(last < a or first > b for _, _, a, b in out):
            out.append((-t, n, first, last))
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs: doc_id, matches array<struct<license, coverage, start, end>> (code points, end exclusive)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(templates or TEMPLATES))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callnet.llm.wordhash import word_blocks

        index = Index(pickle.loads(sent.value))
        for batch in batches:
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for block in word_blocks(batch.column(1), "alnum"):
                hits: dict[int, list[tuple[int, int, int]]] = {}
                doc = block.doc_of_word()
                for k, (keys, template, place) in index.tables.items():
                    own = _runs(block.hash, k)
                    at = np.flatnonzero(doc[: len(own)] == doc[k - 1 :]) if len(own) else np.empty(0, np.int64)
                    lo, up = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
                    for i in np.flatnonzero(up > lo).tolist():
                        d = int(doc[at[i]])
                        for j in range(int(lo[i]), int(up[i])):
                            hits.setdefault(d, []).append((int(template[j]), int(at[i] - block.words[d]), int(place[j])))
                for d, found in hits.items():
                    a, b = block.words[d], block.words[d + 1]
                    raw = block.data[block.offsets[d] : block.offsets[d + 1]]
                    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                    for t, n, first, last in matches(index, block.hash[a:b], found, coverage):
                        start, end = block.start[a + first] - block.offsets[d], block.end[a + last] - block.offsets[d]
                        rows[block.first + d].append({"license": index.names[t], "coverage": n / len(index.words[t]), "start": int(points[start]), "end": int(points[end])})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "matches"])

    schema = "doc_id long, matches array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    line = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select(
        "doc_id", F.size("matches").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"), F.array_join(line, ",").alias("spans"),
    )
