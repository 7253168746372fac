"""Near-duplicate documents by HyperMinHash registers, banding, and exact verification.

A document's set holds the distinct k-word shingles of its whole text (words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer
than k words the sequence is the one member; without words the set is empty and linked with nothing). Documents are linked
when the Jaccard similarity of their sets is `similarity` per cent or more; the result gives each document the least doc_id
that links lead to.

1. `signatures`: one hash per shingle fills `REGISTERS` buckets; each keeps the leading-zero count and 10 mantissa bits of its
   least value in 16 bits (HyperMinHash). Equal sets share a 128-bit digest and count once from here on.
2. Bands of `ROWS` registers give candidate buckets; a pair at 80 % misses all 32 with probability 5e-8. Sets of up to `SMALL` members leave
   too many registers empty for that: these, and those up to where a partner may be that small, have bands of `BANDED` independent
   min-hashes, so each pair that may be linked shares one kind of bands. (Empty registers of larger sets are filled from others by fixed
   random probes, for banding only.)
3. `homes`: a bucket's home is its least id. The buckets that one home has hold mostly the same members, so each member goes there once,
   with its full set, and not once per bucket. A home is dealt into blocks of bounded weight; a few of its members, drawn by hash, are in every block.
4. Inside a block (`_linked`) pairs of different components are compared: collision-corrected estimates of the registers first, all that
   lie within 6 standard errors of the threshold then on the full sets. What leaves the task are links to the least id of each component
   that was found, so there are fewer links than members, however many pairs are alike or nearly alike.
5. Homes of several blocks that are still several components after that: their members outside the home's largest component meet all other members,
   block by block. So every pair that shares a bucket has been in one task unless links already join it: nothing is capped or given up.

Defined results: rows with the same doc_id count as one document, so their texts' links are joined. A row with a null doc_id is
linked with nothing and kept. Extra columns are ignored here and passed through by `drop_near_duplicates`. Repeated rows
share their result. An empty table gives no rows. A null text counts as empty. A text of any length is one row's work; its set takes 8 bytes a shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.llm.common import discard, fresh, give_back, materialize, read_table
from callnet.operators.graph.components import component_labels

REGISTERS = 256
#: Registers that bands use, and registers per band.
BANDED, ROWS = 128, 4
#: Sets of more members are banded by registers; values kept per set: registers, then min-hashes (zeros for larger sets).
SMALL, WIDTH = 512, REGISTERS + BANDED
#: Weight of a block; a set weighs 1 and 1 more for each `HEAVY` members. Members of a home that are in all its blocks.
BLOCK, HEAVY, ANCHORS = 512, 256, 16
#: Standard errors below the threshold that an estimate may lie.
MARGIN = 6
_HASH_BITS, _MANTISSA = 57, 10


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers per set: (leading zeros + 1) << 10 | mantissa of the least value; 0 if empty."""
    from callnet.llm.wordhash import mix

    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    h = mix(np.concatenate(sets) ^ np.uint64(0x5DEECE66D))
    bucket = np.repeat(np.arange(len(sets)), sizes) * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64)
    value = h >> np.uint64(64 - _HASH_BITS)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    least = np.minimum.reduceat(value[order], first)
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(_HASH_BITS - exponent, 0, 62).astype(np.uint64)
    rest = (least << (zeros + np.uint64(1))) & np.uint64((1 << _HASH_BITS) - 1)
    out.reshape(-1)[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(_MANTISSA) | rest >> np.uint64(_HASH_BITS - _MANTISSA)).astype(np.uint16)
    return out


_MIX = np.random.default_rng(20240503).integers(0, 1 << 64, (2, BANDED), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)


def most_small(similarity: int) -> int:
    """Members of the largest set that may be linked with one of `SMALL`."""
    return SMALL * 100 // similarity


def min_hashes(sets: list[np.ndarray], most: int) -> np.ndarray:
    """One row of `BANDED` independent 16-bit min-hashes per set; 0 if it is empty or has more than `most` members."""
    from callnet.llm.wordhash import mix

    out = np.zeros((len(sets), BANDED), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    at = np.flatnonzero((sizes > 0) & (sizes <= most))
    if len(at):
        h = mix(np.concatenate([sets[i] for i in at]) ^ np.uint64(0xB5297A4D3F84D5B5))
        first = np.cumsum(sizes[at]) - sizes[at]
        for j in range(BANDED):
            out[at, j] = mix(np.minimum.reduceat((h ^ _MIX[1, j]) * _MIX[0, j], first)) >> np.uint64(48)
    return out


def _probes() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    return np.stack([rng.permutation(BANDED) for _ in range(BANDED)])


_PROBES = _probes()


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each row of registers and each band of `rows` (4, 8 or 16) registers."""
    source = regs[:, :BANDED]
    # a set so small that it misses all banded registers is banded by the others
    bare = ~source.any(axis=1)
    if bare.any():
        source = np.where(bare[:, None], regs[:, -BANDED:], source)
    full = source.copy()
    short = np.flatnonzero((source == 0).any(axis=1))
    if len(short):
        part, own = full[short], source[short]
        for probe in _PROBES.T:
            empty = part == 0
            if not empty.any():
                break
            part = np.where(empty, own[:, probe], part)
        full[short] = part
    return _keys(full, rows)


def _keys(values: np.ndarray, rows: int) -> np.ndarray:
    from callnet.llm.wordhash import mix

    words = np.ascontiguousarray(values).view("<u8").reshape(len(values), BANDED // rows, rows // 4)
    key = np.arange(1, BANDED // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rows)
    for j in range(rows // 4):
        key = mix(words[:, :, j] ^ key)
    return key


def all_keys(values: np.ndarray, n: np.ndarray, rows: int, similarity: int) -> np.ndarray:
    """The keys of the register bands, then those of the min-hash bands, for rows of `WIDTH` values; 0 in bands that a set of n members doesn't have."""
    bands = BANDED // rows
    out = np.zeros((len(values), 2 * bands), dtype=np.uint64)
    large, small = n > SMALL, n <= most_small(similarity)
    out[large, :bands] = band_keys(values[large, :REGISTERS], rows)
    out[small, bands:] = ~_keys(values[small, REGISTERS:], rows)
    return out


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that the registers of disjoint sets of a and b members agree by chance (both filled)."""
    la, lb = (np.maximum(x, 1)[:, None] / REGISTERS for x in (a, b))
    width = 2.0 ** -np.arange(1, _HASH_BITS + 1)
    total = la + lb
    return (la * lb / total * width / (1 << _MANTISSA) * (np.exp(-total * width) - np.exp(-2 * total * width))).sum(axis=1)


def estimates(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, registers it rests on) for rows of registers."""
    same = ((x == y) & (x > 0)).sum(axis=1)
    used = ((x > 0) | (y > 0)).sum(axis=1)
    chance = collision_rate(nx, ny) * used
    return np.maximum(same - chance, 0) / np.maximum(used - chance, 1e-9), used


def _floor(similarity: int, used: np.ndarray) -> np.ndarray:
    """The least estimate that a pair at the threshold may have."""
    t = similarity / 100
    return t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def likely(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows of registers that may reach the similarity, their estimates). The correction lowers the raw share, so what fails by that is out."""
    same = ((x == y) & (x > 0)).sum(axis=1)
    used = ((x > 0) | (y > 0)).sum(axis=1)
    at = np.flatnonzero(same >= _floor(similarity, used) * used)
    got, used = estimates(x[at], y[at], nx[at], ny[at])
    ok = got >= _floor(similarity, used)
    return at[ok], got[ok]


def signatures(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """(doc_id, n_shingles, node, regs): node is the set's digest, null for an empty set; regs: its registers and min-hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callnet.llm.wordhash import shingle_sets, word_blocks

        for batch in batches:
            for block in word_blocks(batch.column(1)):
                sets = list(shingle_sets(block, k))
                regs = np.concatenate([registers(sets), min_hashes(sets, most_small(similarity))], axis=1)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "n_shingles", "node", "regs"],
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, node binary, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, WIDTH)


def homes(nodes: DataFrame, similarity: int) -> DataFrame:
    """(home, id, n), distinct: the ids of each bucket that holds several, with the bucket's least id."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy()
                keys = all_keys(_matrix(batch.column(1)), n, ROWS, similarity)
                row, band = np.nonzero(keys)
                columns = [pa.array(keys[row, band].view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(n[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n"])
        give_back()

    keyed = nodes.select("id", "regs", "n").mapInArrow(spread, "key long, id long, n long")
    shared = keyed.groupBy("key").agg(F.min("id").alias("home"), F.max("id").alias("last")).where("home < last").select("key", "home")
    return _looked_up(keyed, shared, "key", "keys").select("home", "id", "n").distinct()


def _looked_up(rows: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """rows joined with an aggregate of theirs by a key that may hold a third of them. The aggregate is written first: joined as a plan it would fix the
    partitioning of the rows, and adaptive execution can split a hot key only where both sides are shuffled for the join alone."""
    return rows.join(materialize(table, name), key)


def _weight() -> object:
    return 1 + F.floor(F.col("n") / HEAVY)


def _sized(members: DataFrame) -> DataFrame:
    """members (home, id, n, ..) with c, the home's rows, and blocks, into how many it is dealt."""
    totals = members.groupBy("home").agg(F.count(F.lit(1)).alias("c"), F.sum(_weight()).alias("w"))
    return _looked_up(members, totals.select("home", "c", F.ceil(F.col("w") / BLOCK).cast("int").alias("blocks")), "home", "totals")


def _dealt(sized: DataFrame) -> DataFrame:
    """(home, at, id, n): each member in its block, the home and some `ANCHORS` others in all."""
    anchor = (F.col("id") == F.col("home")) | (F.pmod(F.xxhash64(F.lit("anchor"), "id"), "c") < ANCHORS)
    own = F.array(F.pmod(F.xxhash64("home", "id"), F.col("blocks")).cast("int"))
    return sized.select("home", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("at"), "id", "n")


def _full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, members): sorted distinct shingle hashes of the documents named in ids."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callnet.llm.wordhash import shingle_sets, word_blocks

        for batch in batches:
            for block in word_blocks(batch.column(1)):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(block, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(sets)), pa.array(sets, pa.binary())], names=["id", "members"])
        give_back()

    # a shuffle of the texts whatever the size of ids, which grow with the documents
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return wanted.select("id", "text").mapInArrow(collect, "id long, members binary")


def _linked(label: np.ndarray, sets: list[np.ndarray], similarity: int, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """[(a, b)], a < b: links to the least label of each component that pairs of a first and a second row make of labels.

    A row of `first` is compared with the rows of `second` that aren't in its component yet. Rows of equal labels are one component.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    regs = registers(sets)
    start = np.cumsum(sizes) - sizes
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.empty(0), np.empty(0, np.int64))
    mine = np.zeros(len(distinct), dtype=bool)
    group = label.copy()  # the least label of the component found so far
    for i in np.flatnonzero(first).tolist():
        other = np.flatnonzero(second & (group != group[i]) & (100 * np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i])))
        if not len(other):
            continue
        other = other[likely(regs[other], np.broadcast_to(regs[i], (len(other), REGISTERS)), sizes[other], np.full(len(other), sizes[i]), similarity)[0]]
        if not len(other):
            continue
        own = flat[start[i] : start[i] + sizes[i]]
        mine[own] = True
        take = np.repeat(start[other] - (np.cumsum(sizes[other]) - sizes[other]), sizes[other]) + np.arange(int(sizes[other].sum()))
        both = np.add.reduceat(mine[flat[take]], np.cumsum(sizes[other]) - sizes[other], dtype=np.int64)
        mine[own] = False
        for c in np.unique(group[other[100 * both >= similarity * (sizes[i] + sizes[other] - both)]]).tolist():
            low, high = min(c, int(group[i])), max(c, int(group[i]))
            group[group == high] = low
    moved = np.flatnonzero(group != label)
    return sorted(set(zip(group[moved].tolist(), label[moved].tolist(), strict=True)))


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8").astype(np.uint64) for x in table.column("members").to_pylist()]


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links_within(dealt: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b) links from the pairs inside each block."""

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        all_ = np.ones(table.num_rows, dtype=bool)
        return _pairs(_linked(table.column("id").to_numpy(), _sets_of(table), similarity, all_, all_))

    return dealt.select("home", "at", "id").join(sets, "id").groupBy("home", "at").applyInArrow(link, "a long, b long")


def _pending(sized: DataFrame, labels: DataFrame) -> DataFrame:
    """(home, id, n, label, out) of homes of several blocks and several components; out: not of the home's largest component."""
    rows = sized.where("blocks > 1").select("home", "id", "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per = rows.groupBy("home", "label").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("home").agg(F.count(F.lit(1)).alias("n_labels"), F.max(F.struct("c", "label")).alias("top")).where("n_labels > 1")
    return _looked_up(rows, main.select("home", F.col("top.label").alias("main")), "home", "main").select("home", "id", "n", "label", (F.col("label") != F.col("main")).alias("out"))


def _links_across(pending: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b) links between the members outside of a home's largest component and all its members, each block with each."""
    sized = _sized(pending).withColumn("j", F.pmod(F.xxhash64("home", "id"), F.col("blocks")).cast("int")).drop("c")
    blocks = pending.where("out").groupBy("home").agg(F.ceil(F.sum(_weight()) / BLOCK).cast("int").alias("p"))
    rows = _looked_up(sized, blocks, "home", "outsiders").withColumn("i", F.pmod(F.xxhash64(F.lit("out"), "id"), F.col("p")).cast("int"))
    # a member goes to its block with each block of outsiders; an outsider also to its own with each block of members
    left = rows.where("out").select("home", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "id", "label", "out", F.lit(True).alias("left"))
    right = rows.select("home", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), "j", "id", "label", "out", F.lit(False).alias("left"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        left = table.column("left").to_numpy()
        return _pairs(_linked(table.column("label").to_numpy(), _sets_of(table), similarity, left, ~left))

    return left.union(right).join(sets, "id").groupBy("home", "i", "j").applyInArrow(link, "a long, b long")


def _labels(docs: DataFrame, nodes: DataFrame, ties: DataFrame, k: int, similarity: int) -> DataFrame:
    """(id, label) of all ids that have a link; ties: further links (a, b)."""
    shared = materialize(homes(nodes, similarity), "homes")
    sets = materialize(_full_sets(docs, shared.select("id").distinct(), k), "sets")
    sized = materialize(_sized(shared), "sized")
    links = materialize(_links_within(_dealt(sized), sets, similarity).union(ties).distinct(), "links")
    labels = materialize(component_labels(links), "labels")
    pending = materialize(_pending(sized, labels), "pending")
    if pending.limit(1).count():
        more = materialize(links.union(_links_across(pending, sets, similarity)).distinct(), "links")
        before, labels = labels, materialize(component_labels(more), "labels")
        discard(before, more)
    discard(shared, sized, sets, links, pending)
    return labels


def near_duplicate_groups(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    signed = materialize(signatures(docs, k, similarity), "signatures")
    # one node per set
    present = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = materialize(present.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "nodes")
    # a doc_id with several texts ties their sets together
    several = present.groupBy("doc_id").agg(F.min(F.xxhash64("node")).alias("x"), F.max(F.xxhash64("node")).alias("y")).where("x <> y").select("doc_id")
    ties = present.select("doc_id", "node").join(several, "doc_id").join(nodes.select("node", "id"), "node").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    labels = _labels(docs, nodes, ties, k, similarity)
    least = nodes.select("node", "id").join(labels, "id", "left").select("node", F.coalesce("label", "id").alias("label"))
    out = signed.select("doc_id", "n_shingles", "node").join(least, "node", "left")
    # (of a null doc_id nothing is known but its own set)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).cast("long")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group, with all their columns."""
    name = fresh(docs, "near_dup_id")
    groups = near_duplicate_groups(docs, k, similarity)
    kept = groups.where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[name]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"), k=4, similarity=80)


# A set's rarest members, as many as it may lack and one more, meet those of each set that it can be linked with.
ORACLE = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM words),
sets AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS node FROM shingled),
members AS MATERIALIZED (SELECT node, n, unnest(s) AS h FROM sets WHERE doc_id = node),
places AS (SELECT node, n, h, row_number() OVER (PARTITION BY node ORDER BY f, h) AS place FROM members JOIN (SELECT h, count(*) AS f FROM members GROUP BY h) USING (h)),
rare AS MATERIALIZED (SELECT node, n, h FROM places WHERE place <= n - (80 * n + 99) // 100 + 1),
candidates AS (SELECT DISTINCT a.node AS a, b.node AS b FROM rare a JOIN rare b ON a.h = b.h AND a.node <> b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
shared AS (SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS common FROM candidates JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * common >= 80 * (total - common)),
reach(a, b) AS (SELECT DISTINCT node, node FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (node)"""
