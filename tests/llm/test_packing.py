import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from callnet.llm import packing, tokens
from tests.llm.conftest import CLASH

PATH = packing.default_tokenizer()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["a<|endoftext|>b C", "Ünïcode É é x y 'S it's IT'S don't", "", "  ", "日本語 テスト 123abc", "ΣΑΣ ǅ ﬁ", "a.b,c !! ?!a 5,6 x×y a÷b Ÿ ÿß", "\x1ca\x1cb   q", "<|ENDOFTEXT|> x", "İstanbul Kelvin K", "é é x́y »a« “q” ñ,É.", "a\u0085b c \x00 ~~ <| |>", "aaaa" * 900 + " b", "’s x’s"]


def test_ids_are_the_librarys():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcDEFé'ß.,;12 \n\t|<>ñ日") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    lib = library()
    for text, ids in zip(texts, tokens.BatchTokenizer(PATH).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_ids_of_any_marks_with_a_warm_cache():
    """All printable ASCII and several scripts; one tokenizer, so that what it knows of earlier words meets later ones."""
    rng = random.Random(3)
    ascii_ = "".join(map(chr, range(32, 127)))
    alphabets = [ascii_, ascii_ + "\n\t", "0123456789/_`a.,- ", "abcé ßÀ÷×'", "日本語テスト abc12", "αβγΣς я ё 👍🏽\u200d ", "ab _ / 0 "]
    texts = ["0 and/or", "and/or 0", "10/10", "a _ b", "see x/y, total 0"] + ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in alphabets for _ in range(1500)]
    rng.shuffle(texts)
    lib, t = library(), tokens.BatchTokenizer(PATH)
    want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 500):
        for text, ids, w in zip(texts[at : at + 500], t.encode(pa.array(texts[at : at + 500])), want[at : at + 500], strict=True):
            assert ids.tolist() == w, text


def test_long_texts_and_long_words():
    """A word of a megabyte takes seconds; a text of several blocks is cut at blanks only."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 9))) for _ in range(400_000))
    word = "".join(rng.choice("etaoinsh") for _ in range(1_000_000))
    lib, t = library(), tokens.BatchTokenizer(PATH)
    assert len(long) > 3 * tokens.BLOCK
    for text in (long, word, "x " + word + "\n!", "é" * 5000 + "!" * 5000, " " * 3_000_000):
        assert next(iter(t.encode(pa.array([text])))).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_known_words_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 50)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(k, k + 40)) for k in range(0, 200, 20)]
    t, lib = tokens.BatchTokenizer(PATH), library()
    for text in texts:
        assert next(iter(t.encode(pa.array([text])))).tolist() == lib.encode(text, add_special_tokens=False).ids


def check(rows, texts, capacity):
    """Every id once and in place, no sequence too long, offsets without gaps."""
    lib, by_doc, by_sequence = library(), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length) == (r.piece * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_sequences(documents):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "erst", "lyon.", "Éa"]) for _ in range(rng.randint(0, 150))) for _ in range(120)] + [None, "", "the " * 700, "x"]
    rows = packing.pack_documents(documents(texts), PATH, capacity=64).collect()
    n = check(rows, texts, 64)
    assert n <= 1.05 * sum(r.length for r in rows) / 64 + 1


def test_no_documents(documents):
    assert packing.pack_documents(documents([]), PATH).collect() == []


def histogram_of(lengths):
    return dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))


def sequences_of(rows, histogram):
    """How many sequences the intervals make; every rank of every length is in one, none is too full."""
    load, spans = {}, {}
    for n, a, b, copies, first in rows:
        spans.setdefault(n, []).append((a, b))
        for rank in range(a, b):
            s = first + (rank - a) // copies
            load[s] = load.get(s, 0) + n
    for n, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == histogram[n] and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    assert max(load.values()) <= 4096 and sum(load.values()) == sum(n * c for n, c in histogram.items())
    return len(load)


def test_program_covers_exactly_and_tightly():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1, 20000).astype(int) + 1)
    lengths[:6000] = 4096  # a hot length
    histogram = histogram_of(lengths)
    assert sequences_of(packing.intervals(histogram), histogram) <= 1.002 * lengths.sum() / 4096 + 1


def test_long_pieces_take_fewer_sequences_than_best_fit():
    """Where few lengths go together well the program finds which."""
    histogram = histogram_of(np.random.default_rng(6).integers(700, 2200, 5000))
    plain = sum(t for _, t in packing.best_fit_decreasing(histogram, 4096).entries())
    assert sequences_of(packing.intervals(histogram), histogram) < 0.98 * plain


@pytest.mark.parametrize(("sizes", "gap"), [([1], packing.GAP), ([256], packing.GAP), ([100, 120, 150], packing.GAP), (list(range(16, 90)), packing.GAP), (list(range(16, 257)), 0.03)])
def test_gap_and_bound_of_the_program(sizes, gap):
    """241 sizes of random demands end after the greatest number of steps."""
    sizes = np.array(sizes)
    demand = np.random.default_rng(len(sizes)).integers(1, 1000, len(sizes)).astype(float)
    uses, bound = packing.program(sizes, demand, 256)
    assert all((c * sizes).sum() <= 256 for c, _ in uses)
    assert (sum(c * n for c, n in uses) >= demand * (1 - 1e-9)).all()
    value = sum(n for _, n in uses)
    assert bound * (1 - 1e-9) <= value <= (1 + gap) * bound * (1 + 1e-9)
    if len(sizes) == 3:  # two to a sequence, whatever they are
        assert bound == pytest.approx(demand.sum() / 2, rel=0.011)


@pytest.mark.parametrize("seed", range(40))
def test_few_pieces_against_all_partitions(seed):
    """At most one sequence more than the fewest there can be."""
    rng = random.Random(seed)
    lengths = [rng.randint(1, 32) for _ in range(rng.randint(1, 7))]

    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = fewest(rest[1:], [*bins, rest[0]])
        for i, b in enumerate(bins):
            if b + rest[0] <= 32:
                best = min(best, fewest(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]))
        return best

    found = packing.plan(histogram_of(np.array(lengths)), 32)
    assert sorted(n for c, t in found for n, k in c.items() for _ in range(k * t)) == sorted(lengths)
    assert all(sum(n * k for n, k in c.items()) <= 32 for c, _ in found)
    assert sum(t for _, t in found) <= fewest(lengths, []) + (len(lengths) > 4)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_about_as_few_sequences_as_best_fit_on_documents(sf):
    """Their many short pieces let best fit decreasing come within a sequence of the bound; so does the program."""
    import pyarrow.dataset as ds

    column = ds.dataset(f"/root/testdata/{sf}/documents.parquet").to_table(columns=["text"])["text"].combine_chunks()
    lengths = []
    for ids in tokens.BatchTokenizer(PATH).encode(column):
        full, rest = divmod(len(ids) + 1, 4096)
        lengths += [4096] * full + [rest] * (rest > 0)
    histogram = histogram_of(np.array(lengths))
    plain = sum(t for _, t in packing.best_fit_decreasing(histogram, 4096).entries())
    assert sequences_of(packing.intervals(histogram), histogram) <= plain + 1


def test_best_fit():
    found = packing.best_fit_decreasing({5: 2, 3: 1, 2: 1, 7: 1, 8: 1}, 10).entries()
    assert sorted(sorted(n for n, k in c.items() for _ in range(k)) for c, t in found for _ in range(t)) == [[2, 8], [3, 7], [5, 5]]


def test_clashing_names_null_ids_and_repeated_rows(documents):
    texts = ["a b c", None, "", "a b c", "x " * 90]
    rows = packing.pack_documents(documents(texts, [1, None, 1, 1, 2], **CLASH, rank="r", length="l", sequence_id="s", piece="p"), PATH, capacity=16).collect()
    assert sorted(r.length for r in rows if r.doc_id == 1) == [1, 4, 4] and [r.length for r in rows if r.doc_id is None] == [1]
    assert sum(r.length for r in rows) == 4 + 1 + 1 + 4 + 91
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 16
