"""Each query with SQL gives the rows of its SQL, on the smallest tables and on awkward ones."""

import duckdb
import pytest

from callnet.llm import queries

DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]


def same(spark, folder, name):
    c = duckdb.connect()
    for table in ("documents", "pages"):
        path = f"{folder}/{table}.parquet"
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'' if folder == DIR else '/*.parquet'}'")
    got = queries.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r[x] for x in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert same(spark, DIR, name)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls, empty and blank texts, one word, case, other blanks, pairs at and under the threshold, a chain, copies, a repeated line, secrets."""
    folder = tmp_path_factory.mktemp("awkward")
    long = " ".join(WORDS)
    texts = [None, "", " \t\n", "One", "ONE", "one two three", "One\x0bTwo\x0cthree", "É é", "é É", "a b c d e f g", "A b c d e f g h", "x y z u v", long]
    texts += [long + " " + " ".join(f"m{i}" for i in range(n)) for n in (13, 14, 15, 16, 30)] + [long, long.upper()]
    texts += [f"same line\nown {i}\n Same LINE\t\npassword: abcdefgh{i}" for i in range(12)] + ["AKIA" + "Z" * 16 + " " + "0f" * 20]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    pages = [(i, f"http://a.example/{i}", h) for i, h in enumerate([None, "", "a", "é", "a", "<p>\r\n</p>", "é", "a", "A", "x" * 300_000, "x" * 300_000])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_awkward_tables(spark, awkward, name):
    rows = same(spark, awkward, name)
    assert len(rows) == (11 if name == "op6_warc_bundles" else 33)
