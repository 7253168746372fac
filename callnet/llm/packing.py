"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

Texts become token ids (`tokens.BatchTokenizer`) and an end id; a document longer than the capacity is cut into pieces. What
the driver sees is the histogram of piece lengths, which has one number per length whatever the corpus. `plan` works on it alone:

1. `program`: lengths of `SMALL` and more are rounded up to sizes (`UNITS` to a sequence). The linear program "fewest sequences so that each size
   is covered" over all configurations is solved by multiplicative weights: the price of a size is its share of the capacity times a
   weight that falls as the size gets covered; a knapsack by dynamic programming finds the configuration of greatest price, which gets a
   step more. Prices divided by that greatest price are a solution of the dual program, so the gap is known; it ends at `GAP`.
2. `rounded`: the fractional uses are rounded one after the other (what a use loses by rounding the next one gains), never beyond what a size
   has left, and sizes become lengths again, the longest first.
3. `Sequences.fill`: what rounding left, and the lengths below `SMALL`, go by best fit decreasing into the room that is left, then into new sequences.
4. `repaired`: sequences with more room than a bound are taken apart and filled anew by best fit, for falling bounds, as long as that takes no more sequences.

Equal sequences are one entry with a count in all of this, so its work and size depend on the lengths that occur, not on how many pieces there are.

The assignment runs distributed: pieces are ranked within their length (in salted parts, so one length may hold any share of the
rows), and a sorted table of rank intervals turns (length, rank) into a sequence by binary search. The table is broadcast; it has a row for each length of each
kind of sequence, a few ten thousand (some MB), whatever the corpus.

Defined results: a null or empty text is one piece that holds the end id alone. Equal rows are packed each for itself. No rows give no
rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callnet.llm.common import materialize, read_table, salt

CAPACITY = 4096
END_ID = 1
#: Sizes that the program tells apart, and the share of a sequence below which a length is left to best fit.
UNITS, SMALL = 256, 1 / 16
#: The share by which a solution may exceed its lower bound, and steps after which the solution reached is taken.
GAP, MAX_STEPS = 0.01, 20_000
#: How far a step covers its scarcest size, and how strongly a size's weight falls as it gets covered.
STEP, ETA = 0.3, 0.3
#: Room of a sequence beyond which repair takes it apart.
LOOSE = (64, 32, 16, 8, 4, 2, 0)

#: Lengths and how often each occurs in a sequence.
Config = dict[int, int]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callnet.llm.tokens import tokenizer

        t = tokenizer(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(t.encode(batch.column(1))):
                raw, total = ids.astype("<u4").tobytes() + end, len(ids) + 1
                for k, a in enumerate(range(0, total, capacity)):
                    b = min(a + capacity, total)
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            own = batch.column(0).take(pa.array(row, pa.int64()))
            columns = [own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def _dearest(sizes: np.ndarray, prices: np.ndarray, units: int) -> tuple[np.ndarray, float]:
    """(how often each size is in the multiset of greatest price that fits, that price): unbounded knapsack."""
    best = np.zeros(units + 1)
    pick = np.full(units + 1, -1, dtype=np.int64)
    upto = np.searchsorted(sizes, np.arange(units + 1), side="right")
    for c in range(int(sizes[0]), units + 1):
        value = prices[: upto[c]] + best[c - sizes[: upto[c]]]
        j = int(value.argmax())
        if value[j] > best[c - 1]:
            best[c], pick[c] = value[j], j
        else:
            best[c] = best[c - 1]
    counts = np.zeros(len(sizes), dtype=np.int64)
    c = units
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return counts, float(best[units])


def program(sizes: np.ndarray, demand: np.ndarray, units: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """([(copies of each size, how often)], lower bound): a fractional solution that covers the demand of all sizes (ascending, `units` at most).

    Its value is within `gap` of the lower bound on every solution, unless `MAX_STEPS` steps didn't reach that.
    """
    covered = np.zeros(len(sizes))
    uses: dict[bytes, float] = {}
    total = bound = 0.0
    for step in range(1, MAX_STEPS + 1):
        prices = sizes / units * np.exp(-ETA * (covered - covered.min()))
        counts, value = _dearest(sizes, prices, units)
        bound = max(bound, float((prices * demand).sum()) / value)
        on = counts > 0
        more = STEP * float((demand[on] / counts[on]).min())
        covered += counts * more / demand
        total += more
        uses[counts.tobytes()] = uses.get(counts.tobytes(), 0.0) + more
        if step % 50 == 0 and total <= (1 + gap) * bound * covered.min():
            break
    # every size has been covered `covered.min()` times at least
    scale = covered.min() or 1.0
    return [(np.frombuffer(c, dtype=np.int64), n / scale) for c, n in uses.items()], bound


class Sequences:
    """Configurations, how many sequences have each, and the room that these have."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self._entries: list[tuple[Config, int] | None] = []
        self._room: list[tuple[int, int]] = []

    def add(self, config: Config, times: int) -> None:
        room = self.capacity - sum(n * c for n, c in config.items())
        if room:
            insort(self._room, (room, len(self._entries)))
        self._entries.append((config, times))

    def fill(self, length: int, count: int) -> None:
        """Put `count` pieces where least room remains that holds one, as many as fit there."""
        while count:
            i = bisect_left(self._room, (length, -1))
            if i < len(self._room):
                room, k = self._room.pop(i)
                config, times = self._entries[k]
                self._entries[k] = None
            else:
                room, config, times = self.capacity, {}, count
            copies = min(room // length, count)
            used = min(times, count // copies)
            if config and times > used:
                self.add(config, times - used)
            self.add({**config, length: config.get(length, 0) + copies}, used)
            count -= used * copies

    def entries(self) -> list[tuple[Config, int]]:
        return [e for e in self._entries if e is not None]


def best_fit_decreasing(histogram: dict[int, int], capacity: int, into: Sequences | None = None) -> Sequences:
    """Each length, longest first, goes where least room remains."""
    out = Sequences(capacity) if into is None else into
    for n in sorted(histogram, reverse=True):
        out.fill(n, histogram[n])
    return out


def _runs(lengths: list[int], left: dict[int, int], need: int) -> list[tuple[int, int]]:
    """[(length, how many)]: the next `need` pieces of these lengths, which leave `left`."""
    out = []
    for n in lengths:
        k = min(left[n], need)
        if k:
            out.append((n, k))
            left[n] -= k
            need -= k
    return out


def _cut(runs: list[list[tuple[int, int]]]) -> Iterator[tuple[Config, int]]:
    """The sequences that have one piece of each run: (lengths, how many in a row have just these)."""
    ends = [np.cumsum([k for _, k in r]) for r in runs]
    at = 0
    for end in np.unique(np.concatenate(ends)).tolist():
        config: Config = {}
        for r, e in zip(runs, ends, strict=True):
            n = r[int(np.searchsorted(e, at, side="right"))][0]
            config[n] = config.get(n, 0) + 1
        yield config, end - at
        at = end


def rounded(uses: list[tuple[np.ndarray, float]], classes: list[list[int]], left: dict[int, int], into: Sequences) -> None:
    """Whole uses of the fractional ones; classes: the lengths of each size, longest first. What is used leaves `left`."""
    rest = np.array([sum(left[n] for n in c) for c in classes], dtype=np.int64)
    carry = 0.0
    for counts, use in sorted(uses, key=lambda u: (-u[1], u[0].tobytes())):
        carry += use
        on = np.flatnonzero(counts)
        times = min(int(carry), int((rest[on] // counts[on]).min()))
        carry -= int(carry)
        if times:
            rest[on] -= counts[on] * times
            for config, n in _cut([_runs(classes[j], left, times) for j in on.tolist() for _ in range(int(counts[j]))]):
                into.add(config, n)


def repaired(found: list[tuple[Config, int]], capacity: int) -> list[tuple[Config, int]]:
    """Loose sequences taken apart and filled anew, where that takes no more sequences."""
    for bound in LOOSE:
        kept, loose = Sequences(capacity), {}
        for config, times in found:
            if capacity - sum(n * c for n, c in config.items()) <= bound:
                kept.add(config, times)
            else:
                for n, c in config.items():
                    loose[n] = loose.get(n, 0) + c * times
        again = best_fit_decreasing(loose, capacity, kept).entries()
        if sum(t for _, t in again) <= sum(t for _, t in found):
            found = again
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS, gap: float = GAP) -> list[tuple[Config, int]]:
    """[(configuration, sequences that have it)] for all pieces; histogram: how many pieces have each length, 1 to the capacity."""
    left = {n: c for n, c in histogram.items() if c}
    out = Sequences(capacity)
    if capacity in left:
        out.add({capacity: 1}, left.pop(capacity))
    step = -(-capacity // units)
    by_size: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        if n >= SMALL * capacity:
            by_size.setdefault(-(-n // step), []).append(n)
    # a size of the last, partial unit fills a sequence alone
    sizes = np.array(sorted(by_size), dtype=np.int64)
    if len(sizes):
        classes = [by_size[s] for s in sizes.tolist()]
        demand = np.array([float(sum(left[n] for n in c)) for c in classes])
        uses, _ = program(np.minimum(sizes, capacity // step), demand, capacity // step, gap) if capacity // step >= sizes[0] else ([], 0.0)
        rounded([u for u in uses if _fits(u[0], classes, capacity)], classes, left, out)
    return repaired(best_fit_decreasing(left, capacity, out).entries(), capacity)


def _fits(counts: np.ndarray, classes: list[list[int]], capacity: int) -> bool:
    return sum(int(c) * classes[j][0] for j, c in enumerate(counts) if c) <= capacity


def intervals(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, copies, first_sequence): a piece of that length and rank in [from, to) is in first_sequence + (rank - from) div copies."""
    used = dict.fromkeys(histogram, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for config, times in plan(histogram, capacity, units):
        for n, copies in config.items():
            rows.append((n, used[n], used[n] + copies * times, copies, sequence))
            used[n] += copies * times
        sequence += times
    assert used == histogram
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (see `pieces`; it is read three times, so it should be materialized) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # one row per length, `capacity` at most
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    sent = spark.sparkContext.broadcast(pickle.dumps(np.array(sorted(intervals(histogram, capacity)), dtype=np.int64)))
    salted = cut.withColumn("part", salt(F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    counts = salted.groupBy("length", "part").count()  # capacity x SALTS rows at most
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), before.alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local)
    ranked = ranked.join(F.broadcast(before), (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part"))).withColumn("rank", F.col("before") + F.col("local"))
    ranked = ranked.select(*cut.columns, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pickle.loads(sent.value)
        starts = {int(n): k for k, n in reversed(list(enumerate(table[:, 0].tolist())))}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(batch.num_rows, dtype=np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                a = starts[n]
                b = a + int(np.searchsorted(table[a:, 0], n, side="right"))
                at[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            sequence = table[at, 4] + (rank - table[at, 1]) // table[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    placed = ranked.mapInArrow(place, T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType())]))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
