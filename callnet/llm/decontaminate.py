"""Benchmark decontamination by greedy string tiling.

Words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) of a document and of a benchmark item are tiled: the longest common run of words that no
tile covers yet is marked in both, again and again, down to runs of `min_run` words (ties: first in the item, then first in the
document). So reordered passages are found piece by piece. Runs are found as in running Karp-Rabin matching: windows of a search
length are compared by rolling hash, matches are extended word by word, and the search length falls from long to short.
An item is covered by the share of its words in tiles; a document is contaminated if an item is covered by `coverage` or more. Items
with fewer than `min_run` words are matched as one run.

Candidates come from shared seeds: the hashes of all runs of `min_run` words of the items are looked up among those of each document, in
blocks of items of some `BLOCK_BYTES` of text, never sampled. The blocks are counted by a job; the driver reads and broadcasts one at a time, and with several of
them each pass over the documents is written before the next, so no more than a block is ever held. Documents stay where they are:
there is no shuffle of text and no pair of rows is joined.

Defined results: null texts count as empty; an empty item covers nothing. Repeated rows get equal results; rows with null ids
are processed, a null item_id is reported as such; equal items count once. No items overlap with nothing. Extra columns are passed through by `drop_contaminated`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callnet.llm.common import discard, fresh, materialize, read_table

MIN_RUN, COVERAGE = 5, 0.8
BLOCK_BYTES = 8 << 20


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all windows of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    power = np.full(len(words), base, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(words * power))
    inverse = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    return (total[size:] - total[:-size]) * np.multiply.accumulate(inverse)


def _runs(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, item start, document start) of `size` unmarked words or more."""
    hi, hd = _windows(item, size), _windows(doc, size)
    if not len(hi) or not len(hd):
        return []
    taken_i, taken_d = np.append(0, np.cumsum(~free_i)), np.append(0, np.cumsum(~free_d))
    ok_i = np.flatnonzero(taken_i[size:] == taken_i[:-size])
    ok_d = np.flatnonzero(taken_d[size:] == taken_d[:-size])
    order = ok_d[np.argsort(hd[ok_d], kind="stable")]
    keys = hd[order]
    lo, up = np.searchsorted(keys, hi[ok_i], "left"), np.searchsorted(keys, hi[ok_i], "right")
    out = []
    for i, a, b in zip(ok_i.tolist(), lo.tolist(), up.tolist(), strict=True):
        for d in order[a:b].tolist():
            if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                continue  # not its run's first window
            n = 0
            while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                n += 1
            if n >= size:
                out.append((n, i, d))
    return out


def tiles(item: np.ndarray, doc: np.ndarray, min_run: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item start, document start), as marked: longest first, then by item and document position."""
    least = min(min_run, len(item))
    if not least:
        return []
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    out: list[tuple[int, int, int]] = []
    size = len(item)
    while True:
        found = _runs(item, doc, free_i, free_d, size)
        if found:
            best = max(n for n, _, _ in found)
            for n, i, d in sorted((x for x in found if x[0] == best), key=lambda x: (x[1], x[2])):
                if free_i[i : i + n].all() and free_d[d : d + n].all():
                    free_i[i : i + n] = free_d[d : d + n] = False
                    out.append((n, i, d))
            continue  # marking may have cut other runs: search again at this length
        if size == least:
            return out
        size = max(least, size // 2)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items in blocks, each read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    if size is None:
        return
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if rows:
            yield rows


def _hashed(rows: list[tuple[int | None, str]]) -> list[tuple[int | None, np.ndarray]]:
    """Items as word hashes."""
    from callnet.llm.wordhash import word_blocks

    items = []
    for block in word_blocks(pa.array([t for _, t in rows], pa.string())):
        items += [block.hash[a:b].copy() for a, b in zip(block.words[:-1], block.words[1:], strict=True)]
    return [(i, words) for (i, _), words in zip(rows, items, strict=True)]


class _Seeds:
    """Sorted seed hashes of a block of items, with the item each belongs to; by seed length."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], min_run: int):
        self.items, found = items, {}
        for j, (_, words) in enumerate(items):
            k = min(min_run, len(words))
            if k:
                h = np.unique(_windows(words, k))
                found.setdefault(k, []).append((h, np.full(len(h), j)))
        self.by_size = {}
        for k, parts in found.items():
            h, j = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_size[k] = h[order], j[order]

    def hits(self, block, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word positions of the block, items) with an equal seed of k words."""
        h, j = self.by_size[k]
        own = _windows(block.hash, k)
        doc = block.doc_of_word()
        at = np.flatnonzero(doc[: len(own)] == doc[k - 1 :]) if len(own) else np.empty(0, np.int64)
        lo, up = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
        n = up - lo
        some = np.flatnonzero(n)
        at, lo, n = at[some], lo[some], n[some]
        first = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), j[first]


def _near(words: np.ndarray, seeds: np.ndarray, reach: int) -> np.ndarray:
    """The words within reach of a seed; other words are replaced by one that matches nothing."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(seeds - reach, 0), 1)
    np.add.at(edge, np.minimum(seeds + reach, len(words)), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _covered(seeds: _Seeds, block, min_run: int) -> dict[int, list[tuple[int, float, list[tuple[int, int, int]]]]]:
    """Per document of the block: (item number, coverage, tiles with document positions) of the items that share a seed."""
    out: dict[int, list[tuple[int, float, list[tuple[int, int, int]]]]] = {}
    for k in seeds.by_size:
        at, item = seeds.hits(block, k)
        if not len(at):
            continue
        doc = np.searchsorted(block.words, at, side="right") - 1
        order = np.lexsort((at, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
            d, j = int(doc[a]), int(item[a])
            words, own = block.hash[block.words[d] : block.words[d + 1]], seeds.items[j][1]
            keep = _near(words, at[a:b] - block.words[d], len(own))
            # gaps between the kept stretches become a word that no item has
            part = words[keep]
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            cutout = np.insert(part, gap, np.uint64(0))
            place = np.insert(keep, gap, -1)
            found = tiles(own, cutout, min_run)
            share = sum(n for n, _, _ in found) / len(own)
            out.setdefault(d, []).append((j, share, [(n, i, int(place[p])) for n, i, p in found]))
    return out


RESULT = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<length:int,item_start:int,doc_start:int>>>>"


def overlaps(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs with one column more, `overlaps`: the items that share a run with the text, with coverage and tiles (word positions)."""
    spark = docs.sparkSession
    name = fresh(docs, "overlaps")
    kind = T._parse_datatype_string(RESULT)
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("length", pa.int32()), ("item_start", pa.int32()), ("doc_start", pa.int32())])))]))
    out = docs.withColumn(name, F.array().cast(kind))
    written = sent = None
    for k, rows in enumerate(_blocks(benchmark)):
        if k:
            before, written = written, materialize(out, "overlaps")
            out = written
            discard(before)
            sent.destroy()
        sent = spark.sparkContext.broadcast(pickle.dumps(_hashed(rows)))
        at, last = out.columns.index("text"), len(out.columns) - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at, last=last, schema=out.schema) -> Iterator[pa.RecordBatch]:
            from callnet.llm.wordhash import word_blocks

            seeds = _Seeds(pickle.loads(sent.value), min_run)
            for batch in batches:
                before = batch.column(last).to_pylist()
                for block in word_blocks(batch.column(at)):
                    for d, found in _covered(seeds, block, min_run).items():
                        new = [{"item_id": seeds.items[j][0], "coverage": share, "tiles": [{"length": n, "item_start": i, "doc_start": p} for n, i, p in t]} for j, share, t in sorted(found, key=lambda x: x[0])]
                        before[block.first + d] = before[block.first + d] + new
                columns = [*batch.columns[:last], pa.array(before, arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def contaminated(found: str, coverage: float) -> object:
    """Whether a column of overlaps has an item that is covered enough."""
    return F.exists(F.col(found), lambda x: x["coverage"] >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs in which no item is covered enough, with all their columns."""
    found = overlaps(docs, benchmark, min_run)
    return found.where(~contaminated(found.columns[-1], coverage)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, read_table(spark, sf_dir, "benchmark"))
    covered = F.filter("overlaps", lambda x: x["coverage"] >= COVERAGE)
    return found.select(
        "doc_id", contaminated("overlaps", COVERAGE).alias("contaminated"), F.transform(covered, lambda x: x["item_id"]).alias("item_ids"),
        F.size("overlaps").alias("n_overlaps"), F.coalesce(F.array_max(F.transform("overlaps", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )
