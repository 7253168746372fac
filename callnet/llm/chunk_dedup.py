"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: h = (h << 1) + G[byte]; bit b depends on b + 1 bytes, so the low 14 bits that are used on 14 bytes of context only. Of each
`WINDOW` words in a row, the chunks end before the one (the last of equals) that has the least hash; that is after 5 or 6 words on average,
and never after more than `WINDOW`. They also end where `MASK_BITS` bits of the hash are zero, which cuts long words. So the ends within a passage follow from the
passage alone, wherever it occurs, but for its first 14 bytes and the `WINDOW` words at either end: behind an insertion they fall into
place again, and text of one word or of few, repeated, is cut the same in each copy. Nothing depends on where the chunk before ended, save
in chunks of more than `MAX_CHUNK` bytes, which need a word of that length.

Chunks are counted by a 64-bit digest over documents (a span needs several neighbouring repeats, so a chance
collision makes none), with map-side combining; the digests found in two documents or more go
back to the chunks over salted ranges (as in `line_dedup`), so a chunk that a third of the rows hold is spread over many
tasks. Neighbouring repeated chunks of a document make a span; spans of `MIN_WORDS` words or more are reported with byte positions. Any passage of
50 words keeps that many in whole chunks: 50 less at most 7 words that begin in 14 bytes and 19 in two windows. Spans in which every chunk occurred earlier (in a document with a
smaller doc_id) may be removed; the occurrences in the document with the least doc_id stay.

Defined results: null or empty texts have no chunks. Rows equal in doc_id and text are one document and get the same result; a chunk
that repeats within one document only is not a repeat. Null doc_ids are a value like any other, before all others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callnet.llm.common import read_table, salt, salt_mask, salts_of

MASK_BITS, MAX_CHUNK = 12, 1 << 14
#: Bytes that a chunk end depends on, and words of which one at least begins a chunk.
CONTEXT, WINDOW = 14, 10
MIN_WORDS = 24
_NO_ID = -(1 << 63)


def _gear() -> np.ndarray:
    return np.random.default_rng(20240502).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


GEAR = _gear()
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (CONTEXT - MASK_BITS))


def word_cuts(h: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word beginnings that have the least hash of the bytes before them in some window of `WINDOW` words of a document, the last of equals."""
    at = np.flatnonzero(begins)
    at = at[~np.isin(at, offsets)]  # a document begins a chunk anyway
    if len(at) < WINDOW:
        return at[:0]
    # the least key is the least hash and, of equals, the last
    key = ((h[at - 1] & np.uint32((1 << CONTEXT) - 1)).astype(np.int64) << 32) + np.arange(len(at), 0, -1)
    windows = np.lib.stride_tricks.sliding_window_view(key, WINDOW)
    doc = np.searchsorted(offsets, at, side="right")
    whole = doc[: len(windows)] == doc[WINDOW - 1 :]
    return at[np.unique(np.arange(len(windows))[whole] + windows[whole].argmin(axis=1))]


def boundaries(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
    """Chunk ends (exclusive) of all documents of a block, in order; every document ends a chunk. begins: where words begin; without, only the mask cuts."""
    n = len(data)
    h = GEAR[data]
    head = offsets[:-1]
    width = 1
    while width < 16:  # h over the last 2 * width bytes from h over the last `width`
        h[width:] += h[: n - width] << np.uint32(width)
        width *= 2
    cut = (h & _MASK) == 0
    # the hash starts anew with each document: near its beginning it is that of the fewer bytes
    x, size = np.zeros(len(head), dtype=np.uint32), np.diff(offsets)
    for j in range(15):
        on = np.flatnonzero(size > j)
        at = head[on] + j
        x[on] = (x[on] << np.uint32(1)) + GEAR[data[at]]
        h[at] = x[on]
        cut[at] = x[on] & _MASK == 0
    cut[offsets[1:][offsets[1:] > head] - 1] = True
    if begins is not None:
        cut[word_cuts(h, begins, offsets) - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.append(0, ends[:-1])
    long = np.flatnonzero(ends - starts > MAX_CHUNK)
    if len(long):
        more = [np.arange(a + MAX_CHUNK, b, MAX_CHUNK) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, start, size, words, h): the chunks of each text; start and size in bytes, words: those that begin in it."""
    schema = "doc_id long, th long, pos int, start long, size int, words int, h long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callnet.llm.wordhash import _BLANK, byte_blocks, mix, polynomials

        for batch in batches:
            for first, _, data, offsets in byte_blocks(batch.column(2)):
                if not len(data):
                    continue
                inside = ~_BLANK[data]
                begins = inside & np.append(True, ~inside[:-1])
                begins[offsets[:-1][np.diff(offsets) > 0]] |= inside[offsets[:-1][np.diff(offsets) > 0]]
                ends = boundaries(data, offsets, begins)
                starts = np.append(0, ends[:-1])
                doc = np.searchsorted(offsets, starts, side="right") - 1
                words = np.diff(np.searchsorted(np.flatnonzero(begins), np.append(0, ends)))
                digest = mix(polynomials(data, starts, ends, mix(np.arange(1, 257, dtype=np.uint64))) + (ends - starts).astype(np.uint64))
                own = np.searchsorted(doc, np.arange(len(offsets)))
                pos = np.arange(len(doc)) - own[doc]
                rows = pa.array(first + doc)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos.astype(np.int32)), pa.array(starts - offsets[doc]), pa.array((ends - starts).astype(np.int32)), pa.array(words.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digest.view(np.int64))], names=["doc_id", "th", "pos", "start", "size", "words", "h"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return texts.mapInArrow(cut, schema)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, start, end, words, later): spans of repeated chunks; later: every chunk of it occurred in an earlier place."""
    # narrow rows: where a chunk lies in one number, its size and words in another
    rows = chunks(docs).select("h", "doc_id", "th", F.expr("(CAST(pos AS BIGINT) << 31) | start").alias("at"), F.expr("size * 1024 + words").alias("extent"))
    part = salt(F.col("doc_id"), F.col("th"))
    who = F.xxhash64("doc_id", "th")
    counted = rows.groupBy("h").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("first_id"), salt_mask(part).alias("parts")).where("lo <> hi")
    heads = counted.select("h", "first_id", F.explode(salts_of(F.col("parts"))).alias("part"))
    streamed = rows.withColumns({"part": part, "first_id": F.lit(None).cast("long")}).unionByName(heads, allowMissingColumns=True)
    streamed = streamed.repartitionByRange("h", "part").sortWithinPartitions("h", "part", F.col("first_id").desc_nulls_last())
    over = Window.partitionBy("h", "part").orderBy(F.col("first_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    repeated = streamed.withColumn("head", F.first("first_id", ignorenulls=True).over(over)).where("at IS NOT NULL AND head IS NOT NULL")
    own = F.col("head") == F.coalesce("doc_id", F.lit(_NO_ID))
    repeated = repeated.select(
        "doc_id", "th", F.expr("CAST(at >> 31 AS INT)").alias("pos"), F.expr("at & 2147483647L").alias("start"), F.expr("extent div 1024").alias("size"), F.expr("extent % 1024").alias("words"), own.alias("own")
    ).distinct()
    # neighbours: positions that follow one another
    doc = Window.partitionBy("doc_id", "th").orderBy("pos")
    runs = repeated.withColumn("run", F.col("pos") - F.row_number().over(doc)).groupBy("doc_id", "th", "run")
    spans = runs.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("words"), F.bool_and(~F.col("own")).alias("later"))
    return spans.where(F.col("words") >= min_words).drop("run")


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_spans, n_repeated_bytes, n_later_spans, spans (start:end in bytes, comma-joined), repeated."""
    found = repeated_spans(docs, min_words).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "later"))).alias("found"))
    found = found.select(F.col("doc_id").alias("f_doc_id"), F.col("th").alias("f_th"), "found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["f_doc_id"]) & (rows["th"] == found["f_th"]), "left")
    spans = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    return joined.select(
        "doc_id", "n_bytes", F.size(spans).alias("n_spans"), F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_repeated_bytes"),
        F.size(F.filter(spans, lambda x: x["later"])).alias("n_later_spans"), F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        (F.size(spans) > 0).alias("repeated"),
    )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text): texts without the spans that occurred earlier; repeated rows stay repeated rows."""
    schema = "doc_id long, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, kept = (text or "").encode(), 0, []
                for s in spans or []:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                out.append(b"".join([*kept, raw[at:]]).decode(errors="ignore"))  # a cut inside a character loses its other half
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    found = repeated_spans(docs, min_words).where("later").groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    found = found.select(F.col("doc_id").alias("f_doc_id"), F.col("th").alias("f_th"), "found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["f_doc_id"]) & (rows["th"] == found["f_th"]), "left")
    return joined.select("doc_id", "text", "found").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))
