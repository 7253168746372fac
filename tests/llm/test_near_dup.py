import random

import numpy as np
import pytest

from callnet.llm import near_dup
from tests.llm.conftest import CLASH


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, similarity):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= similarity * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    """A family that drifts from copy to copy, pairs near the threshold, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [[word() for _ in range(rng.randint(6, 90))] for _ in range(25)]
    family = [list(texts[0])]
    for _ in range(40):
        copy = list(rng.choice(family))
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(len(copy))] = word()
        family.append(copy)
    near = []
    for t in texts[1:]:
        copy = list(t)
        copy[: rng.randint(0, 3)] = []
        near.append(copy)
    out = [" ".join(t) for t in texts + family + near]
    out += [out[3].upper(), out[3].replace(" ", "\n"), out[4], "one two", "One  Two", "one", "", "  ", None]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(documents, k):
    texts = corpus(k)
    got = near_dup.near_duplicate_groups(documents(texts, [7 * i for i in range(len(texts))], **CLASH), k, 80).collect()
    want = brute([(7 * i, t) for i, t in enumerate(texts)], k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_ids_null_ids_and_no_rows(documents):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = documents([a, b, a, b, a, a], [5, 5, 6, 7, None, 5])
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in near_dup.near_duplicate_groups(docs, 4, 80).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False)]
    kept = near_dup.drop_near_duplicates(docs, 4, 80)
    assert kept.columns == docs.columns and kept.count() == 4
    assert near_dup.near_duplicate_groups(documents([])).count() == 0


def test_estimates_and_bands():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            both = int(2000 * share)
            one = (2000 - both) // 2
            x, y = near_dup.registers([np.unique(pool[: both + one]), np.unique(np.concatenate([pool[:both], pool[both + one :]]))])
            n = np.array([both + one])
            got.append(near_dup.estimates(x[None], y[None], n, n)[0][0])
        assert abs(np.mean(got) - share) < 0.02
    assert near_dup.collision_rate(np.array([1000]), np.array([1000]))[0] < 0.01
    assert (near_dup.registers([np.empty(0, np.uint64)]) == 0).all()
    single = near_dup.registers([np.array([5], np.uint64), np.array([5], np.uint64)])
    for rows in (4, 8, 16):
        keys = near_dup.band_keys(single, rows)
        assert keys.shape == (2, 128 // rows) and (keys[0] == keys[1]).all()


@pytest.mark.parametrize(("both", "one", "other"), [(4, 1, 0), (5, 1, 0), (8, 2, 0), (8, 1, 1), (16, 2, 2), (24, 6, 0), (48, 6, 6), (200, 50, 0), (1000, 250, 0), (1200, 150, 150)])
def test_pairs_at_the_threshold_share_a_band(both, one, other):
    """Of any size: sets that just reach 80 % meet in a bucket and pass the estimate."""
    rng = np.random.default_rng(both)
    n, m, most = both + one, both + other, near_dup.most_small(80)
    for _ in range(10 if both < 100 else 2):
        pools = rng.integers(0, 1 << 63, (300, n + other)).astype(np.uint64)
        sets = [np.unique(p[:n]) for p in pools] + [np.unique(np.append(p[:both], p[n:])) for p in pools]
        rows = np.concatenate([near_dup.registers(sets), near_dup.min_hashes(sets, most)], axis=1)
        sizes = np.repeat([n, m], 300)
        keys = near_dup.all_keys(rows, sizes, near_dup.ROWS, 80)
        assert ((keys[:300] == keys[300:]) & (keys[:300] != 0)).any(axis=1).all()
        assert len(near_dup.likely(rows[:300, : near_dup.REGISTERS], rows[300:, : near_dup.REGISTERS], sizes[:300], sizes[300:], 80)[0]) == 300


@pytest.mark.parametrize("seed", range(3))
def test_short_pairs_at_the_threshold_against_brute_force(documents, seed):
    """Sequences of 7 to 20 words and the same with a word more."""
    rng = random.Random(seed)
    texts = []
    for _ in range(500):
        t = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.choice([7, 7, 8, 11, 20]))]
        texts += [" ".join(t), " ".join([*t, "end"])]
    got = near_dup.near_duplicate_groups(documents(texts), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("seed", range(2))
def test_homes_of_many_blocks_against_brute_force(documents, monkeypatch, seed):
    """Families, and a group whose members lie just under the threshold, over blocks of a few members."""
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    monkeypatch.setattr(near_dup, "ANCHORS", 1)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    texts = corpus(seed)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 2, 2])):
            copy[rng.randrange(80)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    got = near_dup.near_duplicate_groups(documents(texts), 4, 80).collect()
    want = brute(list(enumerate(texts)), 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 30


def test_links_are_a_forest():
    """Of a block of pairs that are all linked, and of one in which none is."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    near = [np.unique(np.append(base[rng.permutation(100)[:97]], rng.integers(0, 1 << 63, 1).astype(np.uint64))) for _ in range(50)]
    far = [np.unique(np.append(base[rng.permutation(100)[:82]], rng.integers(0, 1 << 63, 12).astype(np.uint64))) for _ in range(50)]
    label, all_ = np.arange(50), np.ones(50, dtype=bool)
    assert near_dup._linked(label, near, 80, all_, all_) == [(0, i) for i in range(1, 50)]
    assert near_dup._linked(label, far, 80, all_, all_) == []
    assert near_dup._linked(label, far[:1] * 50, 80, label < 1, label >= 1) == [(0, i) for i in range(1, 50)]
