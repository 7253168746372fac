import random
import zlib

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from callnet.llm import queries, toxicity
from tests.llm.conftest import CLASH
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import library
from tests.llm.test_scans import naive_tiles, prose


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(13)
    texts = [prose(rng, 80) for _ in range(60)]
    for i in range(40, 60):
        texts[i] += " idiot"
    item = prose(rng, 30)
    texts += [texts[0], texts[0] + " extra", "lead " + item, "footer line\n" + prose(rng, 50)] + [f"{prose(rng, 50)}\nfooter line" for _ in range(14)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(40 <= i < 60)) for i in range(62)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(0, item)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    clean = {*range(40), *range(60, 78)}
    assert clean <= set(seen["toxicity"]) and len(set(seen["toxicity"]) & set(range(40, 60))) <= 2
    lines = seen["line_dedup"]
    assert [r.text.count("footer line") for i, r in sorted(lines.items()) if i >= 63] == [1] + [0] * 14
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert not {60, 61} & set(seen["minhash_near_dedup"]) and 0 in seen["minhash_near_dedup"]
    assert set(seen["minhash_near_dedup"]) - set(seen["benchmark_decontamination"]) == {62}
    assert set(seen["best_fit_packing"]) == set(seen["benchmark_decontamination"])
    run = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0]
    assert run == now.agg(F.sum("length")).first()[0]


def awkward(spark, tmp_path, extra):
    """Documents with nulls, empty and repeated rows, ties, and columns named like those that operators use; the folder they lie in."""
    rng = random.Random(14)
    item = prose(rng, 30)
    texts = [prose(rng, 70) for _ in range(40)] + [f"{prose(rng, 40)}\nshared line\n{prose(rng, 40)}" for _ in range(12)]
    texts += [texts[3] + " more", texts[4], "begin " + item + " end", " ".join(item.split()[15:] + ["cut"] + item.split()[:15]), "", "  ", None, "one", "word " * 3000]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(rng, 30), None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in extra:
        docs = docs.withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(i, 1, int(i in (7, 8))) for i in range(40)] + [(None, None, None), (3, 0, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(0, item), (1, None), (None, "")], "item_id long, text string"))):
        df.write.parquet(f"{folder}/{name}.parquet")
    return docs, folder, item


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept."""
    docs, folder, item = awkward(spark, tmp_path, CLASH)
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        assert name == "best_fit_packing" or out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        before, now = now.collect(), spark.read.parquet(f"{folder}/{name}")
        kept[name] = now.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            scored = toxicity.score(docs.select("doc_id", "text", "lang"), model)
            want = scored.where(~toxicity.flag(scored, model)).select("doc_id", "text").collect()
            assert sorted(map(repr, want)) == sorted(repr(Row(doc_id=r.doc_id, text=r.text)) for r in kept[name])
        elif name == "line_dedup":
            want = lines((r.doc_id, r.text) for r in before)
            assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in kept[name])
            assert all(r.n_chars == len(r.text) for r in kept[name] if r.text is not None and r.doc_id is not None)
        elif name == "minhash_near_dedup":
            ids = sorted({r.doc_id for r in before if r.doc_id is not None})
            least = brute([(i, next(r.text for r in before if r.doc_id == i)) for i in ids], 5, 80)
            want = [r for r in before if r.doc_id is None or least[r.doc_id][1] == r.doc_id]
            assert sorted(map(repr, want)) == sorted(map(repr, kept[name]))
        elif name == "benchmark_decontamination":
            words = item.lower().split()
            want = [r for r in before if naive_tiles(words, (r.text or "").lower().split()[:200], 5) < 0.8]
            assert sorted(map(repr, want)) == sorted(map(repr, kept[name])) and 2 <= len(before) - len(want) <= 2
        else:
            lib, want, at = library(), [], {}
            for r in before:
                ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
                want += [(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
            assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in kept[name])
            for r in sorted(kept[name], key=lambda r: r.offset):
                assert r.offset == at.get(r.sequence_id, 0)
                at[r.sequence_id] = r.offset + r.length
            assert max(at.values()) <= 4096


def lines(rows):
    """Of a line in 10 documents or more its first occurrence stays; a document that thereby has blank lines only goes."""
    rows = list(rows)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    where = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if key(line):
                where.setdefault(key(line), set()).add((i is not None, i, p))
    hot = {k: min(x[1] for x in w if x[1] is not None) for k, w in where.items() if len({x[1] for x in w}) >= 10}
    for i, t in rows:
        own, seen = [], set()
        for line in (t or "").split("\n"):
            k = key(line)
            if k not in hot or (hot[k] == i and k not in seen):
                own.append(line)
            seen.add(k)
        whole = "\n".join(own)
        if whole == (t or "") or key(whole):
            yield i, whole


def test_stages_on_an_empty_table(spark, tmp_path):
    docs, folder, _ = awkward(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_ten_queries_and_their_sql():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
