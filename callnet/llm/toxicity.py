"""Toxicity: a convolutional text classifier trained in numpy.

A word (a run of letters, digits and non-ASCII bytes, A-Z lower-cased) is embedded as the sum of the vectors of four hashed
features: the whole word and its first 4, 5 and 6 bytes, so that inflected forms share a part. Filters of widths 1, 2 and 3 slide over the
whole text; each is max-pooled, and a linear layer with a logistic function turns the pooled values into a score. The embedding, the filters and
the linear layer are trained together by Adam on the cross entropy; gradients flow through the words that won the pooling only.
The first coordinate of the embedding starts at the smoothed log odds of its feature among the training documents,
the rest at random.

Training uses all labelled documents that aren't held out, with whole texts, dealt over shares of some `MAX_TRAIN` documents (`MAX_SHARES` shares at
most). Each epoch every share goes on from the common model, batch by batch, and the mean of the shares' models is the next common one; one task takes that mean and writes it.
Word counts are summed over all shares. The model and the state of its steps are about 7 MB of numbers, the same for any corpus; they go from task to task, and the driver gets the last model.

Thresholds by language: for each language of the training labels with both classes, the threshold of greatest F1 on the training part
that the gradient steps did not use; other languages use the common one, and a null lang counts as the empty string. Labels, lang, source and
doc_id are no inputs of a score; `flag` compares a score with the threshold of the row's lang.

Defined results: an empty or null text scores as its bias says; one in fifty training examples is empty, so that this is low. Labels that are null or belong to no document are ignored; of
repeated labels of a document the greatest counts, of repeated doc_ids the least text is trained on. Without both classes the score is
the share of toxic labels (0.5 without labels), and `drop_toxic` drops nothing. Repeated rows get equal scores. A table without lang has the
common threshold. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.functions.ordering import ranked
from callnet.llm.common import discard, free_shuffles, give_back, materialize, read_table

#: Documents and bytes of a share, and the size from which a text is a batch of its own.
MAX_TRAIN, MAX_TRAIN_BYTES, MAX_TEXT_BYTES, MAX_SHARES = 16_000, 64 << 20, 256 << 10, 32
CELLS, DIM = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 12
PARTS = (None, 4, 5, 6)
EPOCHS, BATCH, RATE = 4, 64, 0.01


def features(block) -> np.ndarray:
    """Cell numbers, one row per word and one column per part; each part has its own quarter of the cells."""
    from callnet.llm.wordhash import part_hashes

    quarter = CELLS // len(PARTS)
    out = np.empty((len(block.hash), len(PARTS)), dtype=np.int32)
    for j, h in enumerate([block.hash, *part_hashes(block, PARTS[1:])]):
        out[:, j] = (h % np.uint64(quarter)).astype(np.int32) + j * quarter
    return out


@dataclass
class Model:
    embedding: np.ndarray  # CELLS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: list[np.ndarray]  # per width: FILTERS
    out: np.ndarray  # FILTERS * len(WIDTHS)
    offset: float
    constant: float | None = None
    threshold: float = 0.3
    by_language: dict[str, float] | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out]

    def threshold_of(self, lang: str | None) -> float:
        return (self.by_language or {}).get(lang or "", self.threshold)


def _pool(model: Model, cells: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, list[tuple | None], np.ndarray]:
    """(pooled values per document, what `_winners` needs per width, embedded words); document d has the words [words[d], words[d + 1])."""
    n_docs = len(words) - 1
    x = model.embedding[cells[:, 0]]
    for c in range(1, len(PARTS)):
        x += model.embedding[cells[:, c]]
    pooled, winners = [], []
    doc = np.repeat(np.arange(n_docs), np.diff(words))
    for w, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        value = np.zeros((n_docs, FILTERS), dtype=np.float32)
        m = len(x) - w + 1
        if m > 0:
            conv = x[:m] @ f[0]
            for k in range(1, w):
                conv += x[k : m + k] @ f[k]
            conv += b
            ok = np.flatnonzero(doc[:m] == doc[w - 1 :])
            if len(ok):
                conv, d = conv[ok], doc[ok]
                head = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                top = np.maximum.reduceat(conv, head)
                own = d[head]
                value[own] = np.maximum(top, 0)
                winners.append((conv, ok, head, own, top))
            else:
                winners.append(None)
        else:
            winners.append(None)
        pooled.append(value)
    return np.concatenate(pooled, axis=1), winners, x


def _winners(found: tuple | None, n_docs: int) -> np.ndarray:
    """The first word of each winning window: documents x filters, -1 where nothing positive won."""
    out = np.full((n_docs, FILTERS), -1, dtype=np.int64)
    if found is None:
        return out
    conv, ok, head, own, top = found
    size = np.diff(np.append(head, len(conv)))
    hit = conv == np.repeat(top, size, axis=0)
    at = np.where(hit, np.arange(len(conv))[:, None], len(conv))
    first = np.minimum.reduceat(at, head)
    out[own] = np.where(top > 0, ok[np.minimum(first, len(ok) - 1)], -1)
    return out


def gradients(model: Model, cells: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross entropy of documents by `model.parameters()` and by the offset."""
    n_docs = len(words) - 1
    pooled, found, x = _pool(model, cells, words)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.offset, -30, 30)))
    delta = ((p - y) / n_docs).astype(np.float32)
    grads = [np.zeros_like(q) for q in model.parameters()]
    grads[-1] += pooled.T @ delta
    back = delta[:, None] * model.out[None, :]
    touched = np.zeros_like(x)
    for j, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
        won = _winners(found[j], n_docs)
        d, k = np.nonzero(won >= 0)
        start, g = won[d, k], back[d, j * FILTERS + k]
        np.add.at(grads[1 + len(WIDTHS) + j], k, g)
        for shift in range(w):
            np.add.at(grads[1 + j][shift].T, k, g[:, None] * x[start + shift])
            np.add.at(touched, start + shift, g[:, None] * f[shift][:, k].T)
    hot = np.flatnonzero(np.abs(touched).sum(axis=1))
    for c in range(len(PARTS)):
        np.add.at(grads[0], cells[hot, c], touched[hot])
    return grads, float(delta.sum())


def score_block(model: Model, block) -> np.ndarray:
    n = block.last - block.first
    if model.constant is not None:
        return np.full(n, model.constant)
    pooled, _, _ = _pool(model, features(block), block.words)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.offset, -30, 30).astype(np.float64)))


def _log_odds(cells: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each cell to occur in a toxic document."""
    counts = np.zeros((2, CELLS))
    for c, y in zip(cells, labels, strict=True):
        counts[int(y), np.unique(c)] += 1
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rate = (counts + 0.5) / (totals + 1)
    return np.log(rate[1] / rate[0]) * (counts[1] > 1)


def _start(odds: np.ndarray, share: float, rng: np.random.Generator) -> Model:
    """The model before the first step; share: that of toxic documents."""
    embedding = rng.normal(0, 0.05, (CELLS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -2, 8) / 4
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    for j in range(len(WIDTHS)):
        out[j * FILTERS : j * FILTERS + FILTERS // 2] = np.abs(out[j * FILTERS : j * FILTERS + FILTERS // 2]) + 0.1
    return Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, float(np.log(share / (1 - share)) - 1))


@dataclass
class Steps:
    """What Adam keeps from step to step."""

    first: list[np.ndarray]
    second: list[np.ndarray]
    offset: list[float]
    n: float = 0

    @staticmethod
    def none(model: Model) -> Steps:
        return Steps([np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()], [0.0, 0.0])


def _epoch(model: Model, steps: Steps, cells: list[np.ndarray], y: np.ndarray, used: np.ndarray, rng: np.random.Generator, long: int = 1 << 16) -> None:
    """One pass over the documents in `used`, in batches of BATCH; one of `long` words or more is a batch of its own."""
    short = np.array([len(cells[i]) < long for i in used], dtype=bool)
    own, rest = used[~short], used[short]
    parts = [rng.permutation(rest)[:BATCH] if at + BATCH > len(rest) else rest[at : at + BATCH] for at in range(0, len(rest), BATCH)] + [own[i : i + 1] for i in range(len(own))]
    for part in parts:
        words = np.append(0, np.cumsum([len(cells[i]) for i in part]))
        batch_cells = np.concatenate([cells[i] for i in part]) if words[-1] else np.empty((0, len(PARTS)), np.int32)
        grads, g_offset = gradients(model, batch_cells, words, y[part])
        steps.n += 1
        for q, g, m, v in zip(model.parameters(), grads, steps.first, steps.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**steps.n)) / (np.sqrt(v / (1 - 0.99**steps.n)) + 1e-8) * (g != 0)
        steps.offset = [0.9 * steps.offset[0] + 0.1 * g_offset, 0.99 * steps.offset[1] + 0.01 * g_offset**2]
        model.offset -= RATE * steps.offset[0] / (1 - 0.9**steps.n) / (np.sqrt(steps.offset[1] / (1 - 0.99**steps.n)) + 1e-8)


def train(texts: list[str], labels: list[int], languages: list[str | None], seed: int = 7) -> Model:
    """Fit on whole texts. One in five documents is kept back for the thresholds."""
    from callnet.llm.wordhash import word_blocks

    y = np.array(labels, dtype=np.float32)
    rng = np.random.default_rng(seed)
    empty = Model(np.zeros((1, DIM), np.float32), [], [], np.zeros(0), 0.0)
    if not len(y) or y.min() == y.max():
        empty.constant = float(y.mean()) if len(y) else 0.5
        return empty
    cells: list[np.ndarray] = []
    for block in word_blocks(pa.array(texts, pa.string()), "alnum"):
        f = features(block)
        cells += [f[a:b] for a, b in zip(block.words[:-1], block.words[1:], strict=True)]
    # a text without words is an example of a text that isn't toxic
    blank = max(1, len(y) // 50)
    cells += [np.empty((0, len(PARTS)), np.int32)] * blank
    y, languages = np.append(y, np.zeros(blank, np.float32)), [*languages, *[None] * blank]
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    if y[used].min() == y[used].max():
        held, used = order[:0], order
    odds = _log_odds([cells[i] for i in used], y[used])
    model = _start(odds, float(y.mean()), rng)
    steps = Steps.none(model)
    for _ in range(EPOCHS):
        _epoch(model, steps, cells, y, used, rng)
    _calibrate(model, cells, y, languages, held if len(held) else used)
    return model


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F1 is greatest."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def _calibrate(model: Model, cells: list[np.ndarray], y: np.ndarray, languages: list[str | None], held: np.ndarray) -> None:
    """Shift the scores so that the best common threshold is 0.3, then set the thresholds by language."""
    logits = np.empty(len(held))
    for i, k in enumerate(held):
        pooled, _, _ = _pool(model, cells[k], np.array([0, len(cells[k])]))
        logits[i] = (pooled @ model.out)[0] + model.offset
    mine = y[held]
    if mine.min() == mine.max():
        return
    cut = _best_threshold(logits, mine)
    move = float(np.log(0.3 / 0.7) - cut)
    model.offset += move
    score = 1 / (1 + np.exp(-np.clip(logits + move, -30, 30)))
    model.threshold, model.by_language = 0.3, {}
    lang = np.array([languages[k] or "" for k in held])
    for name in np.unique(lang):
        own = lang == name
        if mine[own].min() != mine[own].max() and mine[own].sum() >= 5:
            model.by_language[str(name)] = _best_threshold(score[own], mine[own])


def held_out(doc_id) -> object:
    """True where crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, max_text: int = MAX_TEXT_BYTES) -> Model:
    """Train on all labelled rows of docs that aren't held out, in shares of some `max_train` documents and `max_bytes`; a text of `max_text` bytes is a batch of its own."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang")).alias("own"))
    rows = texts.join(marked, "doc_id").groupBy("doc_id").agg(F.min("own").alias("own"), F.first("y").alias("y"))
    # one in five is kept back from the steps, for the thresholds
    rows = materialize(rows.select("own.text", "own.lang", "y", F.xxhash64(F.lit("share"), "doc_id").alias("order"), (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0).alias("kept")), "labelled")
    free_shuffles(spark)
    sums = {bool(r["kept"]): r for r in rows.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    n, toxic, size = (sum(r[c] for r in sums.values()) for c in ("n", "toxic", "bytes"))
    if not n or toxic in (0, n):
        discard(rows)
        return Model(np.zeros((1, DIM), np.float32), [], [], np.zeros(0), 0.0, constant=toxic / n if n else 0.5)
    mixed = lambda r: r is not None and 0 < r["toxic"] < r["n"]
    apart = mixed(sums.get(False)) and sums.get(True) is not None
    used = rows.where(~F.col("kept")) if apart else rows
    shares = min(MAX_SHARES, max(-(-n // max_train), -(-size // max_bytes)))
    dealt = used.select("text", "y", F.pmod("order", F.lit(shares)).cast("int").alias("share"), "order")
    odds = _log_odds_of(dealt)
    state = None
    for epoch in range(EPOCHS):
        before, state = state, _mean_of_shares(dealt, shares, state, (odds, toxic / n), epoch, max_text)
        discard(before)
        free_shuffles(spark)
    model = pickle.loads(state.select("model").first()["model"])
    discard(state)
    _set_thresholds(model, rows.where("kept") if apart and mixed(sums.get(True)) else rows)
    discard(rows)
    return model


def _cells(texts: pa.Array) -> list[np.ndarray]:
    from callnet.llm.wordhash import word_blocks

    out: list[np.ndarray] = []
    for block in word_blocks(texts, "alnum"):
        f = features(block)
        out += [f[a:b] for a, b in zip(block.words[:-1], block.words[1:], strict=True)]
    return out


def _log_odds_of(rows: DataFrame) -> np.ndarray:
    """`_log_odds` over all rows (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((2, CELLS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for c, y in zip(_cells(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[y, np.unique(c)] += 1
                totals[y] += 1
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary()), pa.array([totals.tobytes()], pa.binary())], names=["counts", "totals"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0, 0]
        for batch in batches:
            for r in batch.to_pylist():
                sums = [a + np.frombuffer(r[c], np.int64) for a, c in zip(sums, ("counts", "totals"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], names=["counts", "totals"])

    schema = "counts binary, totals binary"
    found = rows.select("text", "y").mapInArrow(count, schema).repartition(1).mapInArrow(add, schema).first()
    counts, totals = np.frombuffer(found["counts"], np.int64).reshape(2, CELLS), np.frombuffer(found["totals"], np.int64)[:, None]
    rate = (counts + 0.5) / (totals + 1)
    return np.log(rate[1] / rate[0]) * (counts[1] > 1)


def _mean_of_shares(rows: DataFrame, shares: int, state: DataFrame | None, begin: tuple[np.ndarray, float], epoch: int, max_text: int) -> DataFrame:
    """One epoch: the mean, weighted by documents, of the models and steps that every share of the rows (text, y, share, order) makes of `state`; a row (model, steps).

    Without a state they begin from the log odds and the share of toxic documents in `begin`.
    """
    odds, toxic = begin if state is None else (None, None)
    parts = ("model", "steps")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = steps = share = None
        seen = 0
        for batch in batches:
            if batch.num_rows and batch.column(2)[0].as_py() is None:  # the first row is the state
                model, steps = (pickle.loads(batch.column(i)[0].as_py()) for i in (4, 5))
                batch = batch.slice(1)
            if not batch.num_rows:
                continue
            if model is None:
                model = _start(odds, toxic, np.random.default_rng(7))
                steps = Steps.none(model)
            share = batch.column(3)[0].as_py()
            cells, y = _cells(batch.column(0)), np.array(batch.column(1).to_pylist(), np.float32)
            seen += len(y)
            # a text without words is an example of a text that isn't toxic
            blank = max(1, len(y) // 50)
            cells += [np.empty((0, len(PARTS)), np.int32)] * blank
            rng = np.random.default_rng([7, epoch, share, seen])
            _epoch(model, steps, cells, np.append(y, np.zeros(blank, np.float32)), rng.permutation(len(cells)), rng, max_text // 4)
            del cells, batch
            give_back()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([seen]), *[pa.array([pickle.dumps(x)], pa.binary()) for x in (model, steps)]], names=["share", "n", *parts])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, out = 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(1)[i].as_py()
                total += n
                model, steps = (pickle.loads(batch.column(j)[i].as_py()) for j in (2, 3))
                if out is None:
                    out = model, steps
                    continue
                part = n / total
                for mine, other in zip([*out[0].parameters(), *out[1].first, *out[1].second], [*model.parameters(), *steps.first, *steps.second], strict=True):
                    mine += (part * (other - mine)).astype(mine.dtype)
                out[0].offset += part * (model.offset - out[0].offset)
                out[1].offset = [a + part * (b - a) for a, b in zip(out[1].offset, steps.offset, strict=True)]
                out[1].n += part * (steps.n - out[1].n)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x)], pa.binary()) for x in out], names=list(parts))
        give_back()

    rows = rows.select("text", "y", "order", "share", *[F.lit(None).cast("binary").alias(c) for c in parts])
    if state is not None:
        # (no order comes first)
        sent = state.select(F.lit("").alias("text"), F.lit(0).alias("y"), F.lit(None).cast("long").alias("order"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), *parts)
        rows = rows.union(sent)
    # sorted, so that batches are the same on every run
    dealt = (rows.repartitionById(shares, "share") if shares > 1 else rows.repartition(1)).sortWithinPartitions("order", "text")
    made = dealt.mapInArrow(learn, "share int, n long, model binary, steps binary")
    return materialize(made.repartition(1).sortWithinPartitions("share").mapInArrow(mean, "model binary, steps binary"), "model")


def _best_of_groups(counts: DataFrame) -> dict[str | None, tuple[float, int, int]]:
    """By group of (g, s, n, hits): the middle of the gap in the scores s at which F1 is greatest, rows and toxic rows."""
    # each step is written: a plan that holds the ranks several times makes them as often
    placed = materialize(ranked(counts, [F.col("g"), F.desc("s")], {"rows": "n", "found": "hits"}), "placed")
    groups = materialize(placed.groupBy("g").agg(F.sum("n").alias("total"), F.sum("hits").alias("toxic"), F.min(F.col("rows") - F.col("n")).alias("r0"), F.min(F.col("found") - F.col("hits")).alias("f0")), "groups")
    f1 = 2.0 * (F.col("found") - F.col("f0")) / (F.col("rows") - F.col("r0") + F.col("toxic"))
    joined = placed.join(groups, placed["g"].eqNullSafe(groups["g"])).drop(groups["g"])
    best = materialize(joined.groupBy("g", "total", "toxic").agg(F.max_by("s", F.struct(f1, F.col("s"))).alias("best")), "best")
    lower = placed.select("g", "s").join(best, placed["g"].eqNullSafe(best["g"])).drop(best["g"])
    below = lower.groupBy("g", "total", "toxic", "best").agg(F.max(F.when(F.col("s") < F.col("best"), F.col("s"))).alias("next"))
    found = {r["g"]: ((r["best"] + (r["next"] or 0.0)) / 2, r["total"], r["toxic"]) for r in below.collect()}
    discard(placed, groups, best)
    return found


def _set_thresholds(model: Model, rows: DataFrame) -> None:
    """Shift the scores so that the best common threshold is 0.3, then set the thresholds by language, from all rows (text, lang, y)."""
    scored = score(rows.select("text", "lang", "y"), model)
    # a row counts in its language's group and in the common one, which has no name
    own = scored.select(F.explode(F.array(F.lit(None).cast("string"), F.col("lang"))).alias("g"), "y", F.col(scored.columns[-1]).alias("s"))
    counts = materialize(own.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")), "scores")
    logit = lambda p: float(np.log(np.clip(p, 1e-13, 1 - 1e-13) / (1 - np.clip(p, 1e-13, 1 - 1e-13))))
    groups = _best_of_groups(counts)
    move = logit(0.3) - logit(groups.pop(None)[0])
    model.offset += move
    model.threshold, model.by_language = 0.3, {}
    for name, (cut, total, toxic) in groups.items():
        if 5 <= toxic < total:
            model.by_language[name] = float(1 / (1 + np.exp(-(logit(cut) + move))))
    discard(counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with one column more, `toxicity_score`."""
    from callnet.llm.common import fresh

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    name = fresh(docs, "toxicity_score")
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callnet.llm.wordhash import word_blocks

        loaded = pickle.loads(sent.value)
        for batch in batches:
            parts = [score_block(loaded, b) for b in word_blocks(batch.column(at), "alnum")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.empty(0))], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def flag(scored: DataFrame, model: Model, score_column: str = "toxicity_score") -> object:
    """Whether the score reaches the threshold of the row's lang; a null lang counts as the empty one."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in scored.columns else F.lit(None).cast("string")
    cases = F.lit(model.threshold)
    for name, t in (model.by_language or {}).items():
        cases = F.when(lang == name, F.lit(t)).otherwise(cases)
    return F.col(score_column) >= cases


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below their language's threshold, with the columns of docs; all rows if the model knows one class alone."""
    if model.constant is not None:
        return docs
    scored = score(docs, model)
    return scored.where(~flag(scored, model, scored.columns[-1])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"), flag(scored, model).cast("int").alias("predicted_by_language"))
