"""Secrets, licenses, fingerprints, decontamination, chunks, archives, toxicity: brute force, round trips, held-out accuracy."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callnet.llm import chunk_dedup, decontaminate, imatch, license_scan, secret_scan, toxicity, warc
from tests.llm.conftest import CLASH

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


# -- secrets


def plain_spans(text, rules):
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m.group(r.measured)) >= r.least:
                out.append((m.start(), i, m.end()))
    return ",".join(f"{rules[i].kind}:{a}:{b}" for a, i, b in sorted(out))


def test_secrets_against_plain_matching(documents):
    texts = [
        "password=token: abcdefghijk", "é API_KEY = 'abcdefgh12' x apikey:\"zzzzzzzz", "tokentokentoken=12345678 secret:short", "AKIAABCDEFGHIJKL AKIA1 AKIAAKIAAKIAAKIA0", "f" * 31 + " " + "0a" * 20 + "g" + "1" * 32,
        "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 40 + " xoxb-1234567890-abc AIza" + "B" * 35, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "x", "", None, "nothing here", "日本 passwd = ababababab 日本", "PASSWORD=x password='longenough' " * 50,
    ]
    docs = documents(texts, **CLASH)
    got = {r.doc_id: r for r in secret_scan.report(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].spans == plain_spans(t or "", secret_scan.RULES)
        assert got[i].base_sha256 == hashlib.sha256(plain_spans(t or "", secret_scan.BASE).encode()).hexdigest()
    assert secret_scan.report(documents([])).count() == 0
    assert secret_scan.report(documents([texts[0], texts[1], texts[1], texts[1]], [1, None, None, 2])).count() == 4


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert set(q("(abc|xyz)+")) == {frozenset({"abc"}), frozenset({"xyz"})}
    assert q("[0-9a-f]{32}") is None and q("(abc)?") is None and q("ab") is None
    assert set(q("ap_?ik")) == {frozenset({"api", "pik"}), frozenset({"ap_", "p_i", "_ik"})}


def test_hex_runs_of_32_and_more_are_the_long_maximal_runs():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("0af g") for _ in range(300)).replace("g", "0" * rng.randint(0, 9))
        assert [m.span() for m in re.finditer("[0-9a-f]{32,}", t)] == [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


# -- fingerprints


def test_edited_texts_and_likeness(spark, documents):
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(150)] + ["", "日本語" * 5, "x", None]
    texts.append(texts[7])
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in imatch.edited_fingerprints(documents(texts, ids), band=(0.5, 20.0)).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    assert got[ids[7]].fingerprint == got[ids[-1]].fingerprint
    long = [got[d] for d, t in order if len(t or "") > 500]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert imatch.edited_fingerprints(documents([])).count() == 0
    same = imatch.edited_fingerprints(documents(["a b", "a b", "c", "d"], [1, 1, None, 1])).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in same) == [(-1, 1), (1, 1), (1, 3), (1, 3)]


def test_fingerprint_is_of_the_sparsest_lexicons(spark):
    """The column expression against a plain loop over the same hashes."""
    text = "the quick brown fox jumps over the lazy dog again and again, quick!"
    full = spark.range(1).select(F.lit(text).alias("text"), F.array_repeat(F.lit(-1).cast("long"), 1 << (imatch.BITS - 6)).alias("bits"))
    row = full.select(imatch.fingerprint(F.col("text"), F.col("bits")).alias("f"), F.sort_array(imatch.term_hashes(F.col("text"))).alias("h")).first()
    parts = {}
    for h in row.h:
        parts.setdefault(h >> 58, []).append(h)
    assert len(row.f) == 4 * imatch.SUBSETS
    for i in range(imatch.SUBSETS):
        assert (row.f[4 * i : 4 * i + 4] == "----") == (i - 32 not in parts)
    alike = spark.createDataFrame([(row.f, row.f), (row.f, "----" * 64), ("----" * 64, "----" * 64)], "a string, b string").select(imatch.likeness(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in alike] == [1.0, 0.0, 0.0]


def spark_hash(*values):
    """xxhash64 of 64-bit integers as Spark chains it: each value's hash is the next one's seed."""
    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_fingerprint_hashes_against_a_plain_loop(spark):
    """With the whole band: per part the terms of the sparsest lexicon that holds one of the text's, hashed in order."""
    from math import floor, log2

    rng = random.Random(21)
    texts = [prose(rng, n) for n in (1, 3, 40, 400)] + ["", "!", "x"]
    full = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("bits", F.array_repeat(F.lit(-1).cast("long"), 1 << (imatch.BITS - 6)))
    for row in full.select("text", imatch.fingerprint(F.col("text"), F.col("bits")).alias("f"), imatch.term_hashes(F.col("text")).alias("h")).collect():
        parts = {}
        for h in sorted(x & ~(3 << 56) for x in row.h):
            parts.setdefault(h >> 58, []).append(h)
        want = ""
        for i in range(-32, 32):
            if i not in parts:
                want += "----"
                continue
            low = parts[i][0] & ((1 << 56) - 1)
            level = min(4 ** (floor(log2(max(low, 1)) / 2) + 1), 1 << 56)  # a lexicon holds the ranks below a power of four
            hashed = spark_hash(parts[i][0])
            for h in parts[i][1:]:
                if h & ((1 << 58) - 1) < level:
                    hashed = spark_hash(hashed, h)
            want += f"{hashed & 0xFFFF:04x}"
        assert row.f == want


def test_large_groups_of_copies_and_near_copies_keep_their_likeness(documents):
    """Groups of a third of the rows, whose words are in no band."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    copied, template = ([word() for _ in range(120)] for _ in range(2))
    near = []
    for _ in range(60):
        t = list(template)
        for _ in range(2):
            t[rng.randrange(120)] = word()
        near.append(" ".join(t))
    texts = [" ".join(copied)] * 60 + near + [" ".join(word() for _ in range(120)) for _ in range(60)] + ["?!", "?!", "!!"]
    got = {r.doc_id: r for r in imatch.edited_fingerprints(documents(texts)).collect()}
    # the next document is the one with the id before
    assert all(got[i].near_next == 1 for i in range(1, 60)) and all(got[i].near_edited > 0.2 for i in range(1, 60))
    assert np.mean([got[i].near_next for i in range(61, 120)]) > 0.85
    assert all(got[i].near_edited > 0.2 for i in range(61, 120))
    assert all("----" * 32 not in got[i].fingerprint for i in range(180))
    assert np.mean([got[i].near_next for i in range(121, 180)]) < 0.05
    assert got[181].near_next == 1 and got[182].near_next == 0


# -- decontamination


def naive_tiles(item, doc, least):
    free_i, free_d, covered = [1] * len(item), [1] * len(doc), 0
    least = min(least, len(item))
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            break
        covered += n
        for x in range(n):
            free_i[i + x] = free_d[d + x] = 0
    return covered / len(item) if item else 0.0


def test_tiling_against_the_definition():
    rng = random.Random(6)
    for _ in range(150):
        item = [rng.randint(1, 9) for _ in range(rng.randint(1, 30))]
        doc = [rng.randint(1, 9) for _ in range(rng.randint(0, 40))] + item[rng.randint(0, 9) :] + item[: rng.randint(0, 9)]
        found = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert sum(n for n, _, _ in found) / len(item) == pytest.approx(naive_tiles(item, doc, 3))


def test_reordered_passages_are_caught_and_clean_documents_stay(spark, documents, monkeypatch):
    rng = random.Random(7)
    items = [prose(rng, 40), prose(rng, 30), "tiny one", "", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    w = items[0].split()
    texts = [prose(rng, 60), " ".join([prose(rng, 20), *w[20:], prose(rng, 9), *w[:20], prose(rng, 5)]), " ".join([*w[:25], prose(rng, 50)]), items[1].upper(), "say tiny one twice", None, "", prose(rng, 3000) + " " + items[1]]
    docs = documents(texts, **CLASH)
    whole = decontaminate.overlaps(docs, bench)
    found = {r.doc_id: {o.item_id for o in r[whole.columns[-1]] if o.coverage >= 0.8} for r in whole.collect()}
    assert found == {0: set(), 1: {0}, 2: set(), 3: {1}, 4: {2}, 5: set(), 6: set(), 7: {1}}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 2, 5, 6}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # the same in several blocks of items
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {0, 2, 5, 6}
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.overlaps(documents([]), bench).count() == 0


# -- chunks


def test_chunk_ends_follow_the_rolling_hash():
    rng = random.Random(8)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 15, 16, 700, 3000)] + [b"a" * 1500]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    want, base = [], 0
    for t in texts:
        h, last = 0, 0
        for i, c in enumerate(t):
            h = ((h << 1) + int(chunk_dedup.GEAR[c])) & 0xFFFF  # 16 bits: what lies 16 bytes back has left them
            if not h & int(chunk_dedup._MASK) or i == len(t) - 1:
                while i + 1 - last > chunk_dedup.MAX_CHUNK:
                    last += chunk_dedup.MAX_CHUNK
                    want.append(base + last)
                want.append(base + i + 1)
                last = i + 1
        base += len(t)
    assert chunk_dedup.boundaries(data, offsets).tolist() == sorted(set(want))


def test_repeated_passages_are_found_behind_insertions(documents):
    rng = random.Random(9)
    passages = [prose(rng, 55) for _ in range(6)]
    clean = [prose(rng, 150) for _ in range(10)]
    texts = clean + [" ".join([prose(rng, rng.randint(0, 60)), p, prose(rng, 40)]) for p in passages for _ in range(2)] + [None, "", "short", "short"]
    docs = documents(texts, **CLASH)
    got = {r.doc_id: r for r in chunk_dedup.report(docs).collect()}
    assert not any(got[i].repeated for i in range(10)) and all(got[i].repeated for i in range(10, 22))
    assert not any(got[i].repeated for i in range(22, 26))
    assert [got[i].n_later_spans > 0 for i in range(10, 22)] == [False, True] * 6
    left = {r.doc_id: r.text for r in chunk_dedup.remove_repeats(docs).collect()}
    assert all(left[i] == (texts[i] or "") for i in [*range(11), 12, 14]) and all(len(left[i]) < len(texts[i]) - 150 for i in range(11, 22, 2))
    twice = chunk_dedup.report(documents([clean[0]] * 3, [1, 1, None])).collect()
    assert [r.repeated for r in twice] == [True] * 3
    assert not chunk_dedup.report(documents([clean[0]] * 2, [1, 1])).first().repeated
    assert chunk_dedup.report(documents([])).count() == 0


def whole_words(passage, before, after):
    """The most words of a passage that lie in whole chunks which are the same in two texts."""
    kept = []
    for x, y in zip(before, after, strict=True):
        text = f"{x} {passage} {y}".encode()
        data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
        blank = np.isin(data, [9, 10, 11, 12, 13, 32])
        begins = ~blank & np.append(True, blank[:-1])
        ends = chunk_dedup.boundaries(data, offsets, begins) - len(x.encode()) - 1
        kept.append(ends[(ends >= 0) & (ends <= len(passage.encode()))])
    same = sorted(set(kept[0].tolist()) & set(kept[1].tolist()))
    best = 0
    for i, a in enumerate(same):
        for b in same[i:]:
            if [e for e in kept[0] if a <= e <= b] == [e for e in kept[1] if a <= e <= b]:
                best = max(best, len(passage.encode()[a:b].split()))
    return best


def test_any_passage_of_50_words_keeps_whole_chunks():
    rng = random.Random(16)
    kinds = [lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))), lambda: rng.choice("abc"), lambda: "x" * rng.randint(1, 3), lambda: "same", lambda: rng.choice(["|", "--", "0"])]
    for i in range(500):
        passage = " ".join(kinds[i % 5]() for _ in range(50))
        sides = [[prose(rng, 30) + " " * rng.randint(0, 9) for _ in range(2)] for _ in range(2)]
        assert whole_words(passage, *sides) >= chunk_dedup.MIN_WORDS


def test_spans_against_counted_chunks(documents):
    """Chunks of each text by itself, counted as byte strings over the distinct documents."""
    rng = random.Random(18)
    shared = [prose(rng, 60) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 60))] + [x for x in rng.sample(shared, rng.randint(0, 3))] + [prose(rng, rng.randint(0, 30))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1] + " end", None, "", "é " * 90 + shared[0], shared[1].upper()]
    cut = []
    for t in texts:
        raw = (t or "").encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        blank = np.isin(data, [9, 10, 11, 12, 13, 32])
        begins = ~blank & np.append(True, blank[:-1])[: len(data)]
        ends = chunk_dedup.boundaries(data, np.array([0, len(data)]), begins).tolist() if raw else []
        cut.append([(a, b, raw[a:b], int(begins[a:b].sum())) for a, b in zip([0, *ends], ends, strict=False)])
    where = {}
    for i, own in enumerate(cut):
        for _, _, piece, _ in own:
            where.setdefault(piece, set()).add(i)
    got = {r.doc_id: r for r in chunk_dedup.report(documents(texts)).collect()}
    some = 0
    for i, own in enumerate(cut):
        spans, run = [], []
        for chunk in [*own, None]:
            if chunk is not None and len(where[chunk[2]]) > 1:
                run.append(chunk)
                continue
            if sum(c[3] for c in run) >= chunk_dedup.MIN_WORDS:
                spans.append((run[0][0], run[-1][1]))
            run = []
        assert got[i].spans == ",".join(f"{a}:{b}" for a, b in spans)
        some += len(spans)
    assert some > 20


def test_short_and_periodic_passages_are_found_in_all_their_documents(documents):
    rng = random.Random(17)
    passages = [prose(rng, 51) for _ in range(200)] + ["| " * 60, "ha " * 70, "ab cd " * 40]
    docs = documents([f"{prose(rng, rng.randint(5, 60))} {p} {prose(rng, 40)}" for p in passages for _ in range(2)])
    assert chunk_dedup.report(docs).where("NOT repeated").count() == 0


# -- licenses


def test_licenses_with_noise_and_spans(documents):
    mit = license_scan.TEMPLATES["mit"].split()
    changed = mit[:30] + ["INSERTED", "WORDS"] + mit[30:60] + mit[62:]
    texts = ["é x. Licensed under the Apache License, Version 2.0. y", "a " * 50 + " ".join(changed) + " b" * 20, license_scan.TEMPLATES["apache-2.0-header"], "released under the mit", "", None, "Licensed under CC BY-NC 4.0.\n" * 3]
    got = {r.doc_id: r.matches for r in license_scan.scan(documents(texts, **CLASH)).collect()}
    assert [(m.license, texts[0][m.start : m.end]) for m in got[0]] == [("apache-2.0-line", "Licensed under the Apache License, Version 2.0")]
    assert [m.license for m in got[1]] == ["mit"] and 0.9 < got[1][0].coverage < 1
    assert texts[1][got[1][0].start : got[1][0].end].startswith("Permission is hereby") and texts[1][: got[1][0].end].endswith("DEALINGS IN THE SOFTWARE")
    assert [m.license for m in got[2]] == ["apache-2.0-header"]
    assert got[4] == got[5] == [] and [m.license for m in got[6]] == ["cc-by-nc-4.0-line"] * 3
    assert license_scan.scan(documents([])).count() == 0


def test_versions_variants_and_changed_words(documents):
    texts = {
        "This work is licensed under the GNU General Public License, version 2": ["gpl-2.0-line"],
        "This work is licensed under the GNU General Public License, version 3": ["gpl-3.0-line"],
        "This work is licensed under the GNU General Public License, version 7": [],
        "This work is licensed under the GNU Lesser General Public License, version 2.1": ["lgpl-2.1-line"],
        "Licensed under CC BY-NC-SA 4.0": ["cc-by-nc-sa-4.0-line"],
        "Licensed under CC BY-ND 3.0": ["cc-by-nd-3.0-line"],
        "Licensed under CC BY 4.0": ["cc-by-4.0-line"],
        "Licensed under the Apache License, Version 1.1": ["apache-1.1-line"],
        "Released under the MIT Licence": ["mit-line"],
        "Published under the MIT License": ["mit-line"],
        "Released under the BSD 3-Clause License": ["bsd-3-clause-line"],
        "Released under the YMCA License": [],
        "we met under the 4.0 bridge by the sea": [],
        license_scan.TEMPLATES["mpl-2.0"]: ["mpl-2.0"],
        "x " + license_scan.TEMPLATES["bsd-3-clause"] + " y": ["bsd-3-clause"],
        license_scan.TEMPLATES["gpl-2.0-or-later"]: ["gpl-2.0-or-later"],
        "intro\n" + license_scan.TEMPLATES["lgpl-3.0-or-later"].replace("and/or modify it", "or change it"): ["lgpl-3.0-or-later"],
    }
    got = {r.doc_id: [m.license for m in r.matches] for r in license_scan.scan(documents(list(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_every_template_is_found_as_itself(documents):
    names = list(license_scan.TEMPLATES)
    got = {r.doc_id: [(m.license, m.coverage) for m in r.matches] for r in license_scan.scan(documents([f"a b {license_scan.TEMPLATES[n]} c" for n in names])).collect()}
    assert [got[i] for i in range(len(names))] == [[(n, 1.0)] for n in names]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(10)
    for _ in range(60):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))], [rng.randint(1, 4) for _ in range(rng.randint(0, 14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(table[i][j] + (x == y), table[i][j + 1], table[i + 1][j])
        n, first, last = license_scan.align(np.array(a), np.array(b, dtype=int), 0, band=20)
        assert n == table[-1][-1] and (n == 0 or 0 <= first <= last < len(b))


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    kept = set(license_scan.winnow(h, 5).tolist())
    assert all(kept & set(range(i, i + 5)) for i in range(196))


# -- archives


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>é</p>"), (2, None, "same"), (3, "u v", "same"), (9, "x", "same"), (4, "u", None), (5, "u", ""), (6, "u", "long " * 90000), (None, "u", "same"), (7, "u", "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for name in ("revisit", "sha", "part"):
        df = df.withColumn(name, F.lit("mine"))
    path = f"file://{tmp_path}/warc"
    bundles = warc.archive(df.repartition(3), path, frame=1000)
    got = {r.page_id: r for r in warc.read_bundles(bundles, path).collect()}
    assert len(got) == len(pages)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h in pages:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        response = best[h or ""]
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if response == i else ("revisit", response))
    files, top = warc.filesystem(path)
    names = [r.bundle for r in bundles.collect()]
    seen = 0
    for name in names:
        with files.open_input_file(f"{top}/{name}") as f:
            reader = warc.BundleReader(f)
            for own, *_ in reader.index:
                headers, block = reader.record(None if own == -(1 << 63) else own)
                seen += 1
                if headers["WARC-Type"] == "response":
                    assert warc.digest(block) == headers["WARC-Payload-Digest"][5:]
    assert seen == len(pages)
    small = warc.archive(df, f"file://{tmp_path}/w2", least=5)
    assert sum(r.record_type == "revisit" for r in warc.read_bundles(small, f"file://{tmp_path}/w2").collect()) == 0
    empty = warc.archive(df.limit(0), f"file://{tmp_path}/w3")
    assert warc.read_bundles(empty, f"file://{tmp_path}/w3").count() == 0


def test_frames_are_plain_zstandard(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    w = warc.BundleWriter(out, frame=100)
    records = [warc.record(i, "u", b"x" * i, None, False) for i in range(30)]
    for i, r in enumerate(records):
        w.add(i, r)
    w.close()
    # any decompressor skips the index and the seek table
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"".join(records)


# -- words


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    """Of texts and words longer than a stretch, too."""
    from callnet.llm import wordhash

    rng = random.Random(20)
    texts = [prose(rng, 300), "", "w" * 3000 + " " + "Ab" * 1500 + " end", None, "  ", prose(rng, 5)]
    whole = list(wordhash.word_blocks(pa.array(texts)))
    assert len(whole) == 1
    monkeypatch.setattr(wordhash, "BLOCK", 512)
    monkeypatch.setattr(wordhash, "_powers", [])
    parts = list(wordhash.word_blocks(pa.array(texts)))
    assert len(parts) > 2 and [b.first for b in parts[1:]] == [b.last for b in parts[:-1]]
    assert np.concatenate([b.hash for b in parts]).tolist() == whole[0].hash.tolist()
    for j in range(2):
        assert np.concatenate([wordhash.part_hashes(b, (3, 5))[j] for b in parts]).tolist() == wordhash.part_hashes(whole[0], (3, 5))[j].tolist()
    a, b = (next(iter(wordhash.word_blocks(pa.array([t])))) for t in ("abcde fghij", "ABCDX fghik"))
    assert wordhash.part_hashes(a, (4,))[0].tolist() == wordhash.part_hashes(b, (4,))[0].tolist()
    assert not set(a.hash.tolist()) & set(b.hash.tolist())


# -- toxicity


def test_toxicity_learns_held_out_words(spark, documents):
    rng = random.Random(11)
    texts, marks = [], []
    for i in range(700):
        t, toxic = prose(rng, 60).split(), i % 5 == 0
        if toxic:
            t[rng.randrange(60)] = rng.choice(["idiotisch", "idiotique", "idioti", "scumbag", "Scum!"])
        texts.append(" ".join(t))
        marks.append(int(toxic))
    docs = documents([*texts, "", None])
    labels = spark.createDataFrame([(i, 0, m) for i, m in enumerate(marks)] + [(3, 0, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    held = [r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect() if r.doc_id < 700]
    assert 100 < len(held) < 250
    right = np.mean([(got[i] >= 0.3) == bool(marks[i]) for i in held])
    assert right > 0.95 and 0 <= got[700] < 0.3 and got[700] == got[701]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 520 < kept.count() < 590


def blocks(texts):
    from callnet.llm.wordhash import word_blocks

    return list(word_blocks(pa.array(texts, pa.string()), "alnum"))


def small_model(rng, offset=0.1):
    filters = [rng.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    bias = [rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    out = rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32)
    return toxicity.Model(rng.normal(0, 0.4, (toxicity.CELLS, toxicity.DIM)).astype(np.float32), filters, bias, out, offset)


def test_gradients_agree_with_differences():
    """Central differences of the loss by numbers of every parameter."""
    rng, words = np.random.default_rng(12), random.Random(12)
    model = small_model(rng)
    (block,) = blocks([prose(words, n) for n in (1, 2, 7, 12)])
    cells, y = toxicity.features(block), np.array([1, 0, 1, 0], dtype=np.float32)
    for name in ("embedding", "out"):  # differences need more digits than training does
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.filters, model.bias = [f.astype(np.float64) for f in model.filters], [b.astype(np.float64) for b in model.bias]

    def loss():
        total = 0.0
        for d in range(4):
            own = cells[block.words[d] : block.words[d + 1]]
            p = plain_score(model, own)
            total -= np.log(p if y[d] else 1 - p) / 4
        return total

    grads, g_offset = toxicity.gradients(model, cells, block.words, y)
    checked = 0
    for q, g in zip(model.parameters(), grads, strict=True):
        at = np.argwhere(g != 0)
        for i in [tuple(x) for x in at[rng.permutation(len(at))[:6]]]:
            keep, step = q[i], 1e-5
            q[i] = keep + step
            up = loss()
            q[i] = keep - step
            down = loss()
            q[i] = keep
            assert (up - down) / (2 * step) == pytest.approx(g[i], rel=2e-2, abs=2e-5)
            checked += 1
    model.offset += 1e-5
    up = loss()
    model.offset -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(g_offset, rel=1e-2, abs=1e-5)
    assert checked > 40


def plain_score(model, cells):
    """The forward pass of one text, window by window."""
    x = [sum(model.embedding[c] for c in word) for word in cells.tolist()]
    value = model.offset
    for j, w in enumerate(toxicity.WIDTHS):
        for k in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(x) - w + 1):
                best = max(best, sum(float(x[i + s] @ model.filters[j][s][:, k]) for s in range(w)) + float(model.bias[j][k]))
            value += best * float(model.out[j * toxicity.FILTERS + k])
    return 1 / (1 + np.exp(-value))


def test_scores_against_a_plain_forward_pass():
    model, rng = small_model(np.random.default_rng(4)), random.Random(4)
    texts = [prose(rng, n) for n in (1, 2, 3, 20, 0, 9)] + ["", None]
    got = np.concatenate([toxicity.score_block(model, b) for b in blocks(texts)])
    want = [plain_score(model, toxicity.features(next(iter(blocks([t]))))) for t in texts]
    assert got == pytest.approx(want, abs=1e-4)


def test_blocks_do_not_matter_and_training_fits():
    rng = random.Random(12)
    texts = [prose(rng, 30) + (" awful" if i % 2 else "") for i in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)], [None] * 60)
    together = np.concatenate([toxicity.score_block(model, b) for b in blocks(texts)])
    single = [toxicity.score_block(model, blocks([t])[0])[0] for t in texts]
    assert together == pytest.approx(single, abs=1e-5)
    assert np.mean((together >= 0.3) == np.array([i % 2 for i in range(60)])) > 0.95


def test_thresholds_by_language_and_long_training_texts(spark, documents):
    model = small_model(np.random.default_rng(5))
    model.threshold, model.by_language = 0.6, {"en": 0.2, "": 0.4}
    rows = spark.createDataFrame([(0.3, "en"), (0.3, None), (0.3, ""), (0.5, "de"), (0.7, "de"), (0.45, None)], "toxicity_score double, lang string")
    assert [r[0] for r in rows.select(toxicity.flag(rows, model)).collect()] == [True, False, False, False, True, True]
    assert [model.threshold_of(x) for x in ("en", None, "", "de")] == [0.2, 0.4, 0.4, 0.6]
    # one text beyond the bounds leaves the others to train on; a table without lang works; repeated ids count once
    texts = ["x " * 400] + ["bad word" if i % 2 else "fine word" for i in range(1, 60)]
    docs = documents([*texts, "bad twice"], [*range(60), 3]).drop("lang")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels, max_train=60, max_bytes=600, max_text=700)
    assert fitted.constant is None
    kept = toxicity.drop_toxic(docs, fitted)
    assert kept.columns == docs.columns and kept.where("text = 'fine word'").count() == 29 and kept.where("text = 'bad word'").count() == 0


def test_training_state_does_not_pass_the_driver(spark, documents, monkeypatch):
    """The driver sent 7 MB of state an epoch and ranked the scores once for all rows and once more for languages; both kinds of thresholds must be those of brute force."""
    rng, sent, ranks = random.Random(31), [], []
    marks = [int(rng.random() < 0.4) for _ in range(200)]
    docs = documents([prose(rng, 12) + (" vile" if m and rng.random() < 0.8 else "") for m in marks]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise(F.lit("en")))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    context, plain = type(spark.sparkContext), type(spark.sparkContext).broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(len(value)) or plain(self, value))
    keep = toxicity.ranked
    monkeypatch.setattr(toxicity, "ranked", lambda *a, **b: ranks.append(1) or keep(*a, **b))
    toxicity.fit(docs, labels, max_train=60)
    assert max(sent) < 3 << 20 and len(ranks) == 1
    rows = [(g, round(rng.random(), 1), rng.randrange(1, 4)) for g in (None, "de", "en") for _ in range(12)]
    rows = [(g, s, n, rng.randrange(n + 1)) for (g, s), n in {(g, s): n for g, s, n in rows}.items()]
    got = toxicity._best_of_groups(spark.createDataFrame(rows, "g string, s double, n long, hits long"))
    for g in (None, "de", "en"):
        own = [(s, n, h) for a, s, n, h in rows if a == g]
        y = np.array([x for s, n, h in own for x in [1.0] * h + [0.0] * (n - h)])
        score = np.array([s for s, n, h in own for _ in range(n)])
        f1 = {c: 2 * y[score >= c].sum() / ((score >= c).sum() + y.sum()) for c in set(score)}
        best = max(c for c in f1 if f1[c] == max(f1.values()))
        assert got[g] == (pytest.approx((best + max([c for c in f1 if c < best], default=0.0)) / 2), len(y), int(y.sum()))


def test_toxicity_learns_from_every_labelled_document(spark, documents):
    """Each of 40 insults stands in few documents, in shares of 60, one of them in a text of over 300 kB; before, documents beyond a count or a size were passed over."""
    rng = random.Random(14)
    insults = ["zq" + "".join(rng.choice("bcdfghkl") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)]
    texts, marks = [], []
    for i in range(1200):
        t = prose(rng, 40).split()
        if i % 4 == 0:
            t[rng.randrange(40)] = insults[i // 4 % 40]
        texts.append(" ".join(t))
        marks.append(int(i % 4 == 0))
    texts += ["gentle words " * 25_000 + insults[0]]
    docs, labels = documents(texts), spark.createDataFrame([(i, m) for i, m in enumerate([*marks, 1])], "doc_id long, toxic int")
    counted = []
    odds = toxicity._log_odds_of
    toxicity._log_odds_of = lambda rows: counted.append((rows.count(), rows.select("share").distinct().count())) or odds(rows)
    try:
        model = toxicity.fit(docs, labels, max_train=300)
    finally:
        toxicity._log_odds_of = odds
    again = toxicity.fit(docs.repartition(7), labels, max_train=300)
    assert all((a == b).all() for a, b in zip(model.parameters(), again.parameters(), strict=True)) and model.offset == again.offset
    usable = docs.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert 0.7 * usable < counted[0][0] < 0.9 * usable and counted[0][1] >= 3
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    held = [r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect() if r.doc_id < 1200]
    assert np.mean([(got[i] >= 0.3) == bool(marks[i]) for i in held]) > 0.95


def test_thresholds_of_groups_against_sorted_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(s), int(rng.random() < s)) for g in ("de", "en", "") for s in rng.integers(1, 60, 80) / 60]
    counts = spark.createDataFrame(rows, "g string, s double, y int").groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    for g, (cut, total, toxic) in toxicity._best_of_groups(counts).items():
        s, y = (np.array([r[i] for r in rows if r[0] == g], dtype=float) for i in (1, 2))
        assert (total, toxic) == (80, y.sum()) and cut == pytest.approx(toxicity._best_threshold(s, y))


def test_toxicity_without_both_classes(spark, documents):
    docs = documents(["a b", "c"], **CLASH)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r[0] for r in toxicity.score(docs, toxicity.fit(docs, none)).select("_toxicity_score").collect()} == {0.5}
    assert toxicity.score(documents([]), toxicity.fit(docs, none)).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, none)).count() == 2
