import hashlib
import random

import pytest

from callnet.llm import line_dedup
from tests.llm.conftest import CLASH

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least, keep):
    where = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if key(line):
                where.setdefault(key(line), {}).setdefault(i, p)
    out = {}
    for i, t in rows:
        lines, kept, seen = (t or "").split("\n"), [], set()
        for p, line in enumerate(lines):
            k = key(line)
            hot = k and len(where[k]) >= least
            first = hot and min(where[k]) == i and where[k][i] == p
            if not hot or (keep == "first" and first):
                kept.append(line)
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
def test_against_brute_force(documents, keep):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(12)] + ["  Line 1\t", "ÉTÉ", "été", "", " ", "\x0bLINE 2"]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {j} {i}" for j in range(rng.randint(1, 9))) for i in range(80)]
    texts += [None, "", "\n\n", "line 1\n" * 300 + "end"]
    docs = documents(texts, **CLASH)
    got = line_dedup.dedup_lines(docs, min_docs=10, keep=keep)
    assert {"th", "salt", "line_runs"} <= set(got.columns)
    want = brute(list(enumerate(texts)), 10, keep)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want
    if keep == "none":
        assert hashlib.sha256(want[0][2].encode()).hexdigest() in {r[0] for r in got.selectExpr("sha2(text, 256)").collect()}


def test_bitmaps_give_runs(documents):
    docs = documents(["a\nb\nb\nc\nb"] + ["b"] * 9)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in line_dedup.line_bitmaps(docs).collect()}
    assert got[0] == [(1, 2), (1, 1)] and got[5] == [(0, 1)]


def test_repeated_rows_nulls_and_no_rows(documents):
    docs = documents(["x"] * 6 + ["x\ny"] * 6, [1] * 6 + [None] * 6)  # every row counts
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=13).collect()} == {(1, 1, 0), (None, 2, 0)}
    got = line_dedup.dedup_lines(docs, min_docs=12).collect()
    assert len(got) == 12 and {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got} == {(1, 1, 1, ""), (None, 2, 1, "y")}
    assert line_dedup.dedup_lines(documents([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, keep="some")
