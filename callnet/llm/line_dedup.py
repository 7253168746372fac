"""Line deduplication with compressed keep bitmaps. DataFrame functions only.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased; lines whose key is
empty always stay. A key that occurs in `min_docs` documents or more is repeated; `keep="none"` drops all its
lines, `keep="first"` spares its first occurrence (least doc_id, then text hash, then position).

How it runs. Keys are hashed to two 64-bit values. One aggregate with map-side combining counts documents per
key; only the repeated keys go on. These, copied to the salts they occur with, and all lines are range-partitioned by
(hash, salt) and sorted by document and position behind the header row of their key, so one streaming pass decides
each line and a key with a third of all lines is spread over many tasks. What comes back per document is not text
but run lengths of kept and dropped lines, a compressed bitmap; the text moves once, to meet its bitmap.

Defined results: a null or empty text is one empty line. Every row counts as a document, repeated rows too; rows equal
in doc_id and text get the same result, and rows that share only doc_id are kept apart. A null doc_id is a value like any
other. An empty table gives an empty table. Other columns, whatever their names, are passed through by `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callnet.llm.common import ascii_lower, fresh, materialize, read_table, salt, salt_mask, salts_of

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), "key")}).drop("key")


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """(doc_id, text_hash, runs): per document with dropped lines, runs array<struct<keep int, drop int>>."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    base = base.withColumn("salt", salt(F.col("doc_id"), F.col("th")))
    rows = _hashed(base.select("doc_id", "th", "salt", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).select("doc_id", "th", "salt", "pos", line_key(F.col("line")).alias("key")).where("key <> ''"))
    # narrow rows, written once: dealing them to ranges reads them twice, and the texts needn't be split each time
    rows = materialize(rows, "lines")
    once = _hashed(base.select("doc_id", "th", "salt", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_key))).alias("key")).where("key <> ''"))
    counted = once.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_docs"),
        salt_mask(F.col("salt")).alias("salts"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"),
    )
    heads = counted.where(F.col("n_docs") >= min_docs).withColumn("salt", F.explode(salts_of(F.col("salts"))))
    streamed = heads.select("h1", "h2", "salt", F.lit(0).alias("kind"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("bigint").alias("th"), F.lit(-1).alias("pos"), "first").unionByName(
        rows.withColumns({"kind": F.lit(1), "first": F.lit(None)}), allowMissingColumns=True
    )
    order = ["h1", "h2", "salt", "kind", "doc_id", "th", "pos"]
    streamed = streamed.repartitionByRange("h1", "h2", "salt").sortWithinPartitions(*order)
    over = Window.partitionBy("h1", "h2", "salt").orderBy("kind", "doc_id", "th", "pos")
    flagged = streamed.withColumn("head", F.first("first").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    if keep == "first":
        same = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.th") == F.col("th"))
        before = F.sum(F.when(same & (F.col("kind") == 1), 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, -1))
        flagged = flagged.withColumn("spared", same & (F.coalesce(before, F.lit(0)) == 0))
    elif keep == "none":
        flagged = flagged.withColumn("spared", F.lit(False))
    else:
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    dropped = flagged.where("kind = 1 AND head IS NOT NULL AND NOT spared").select("doc_id", "th", "pos")
    dropped = dropped.repartition("doc_id", "th").distinct()  # equal rows of the input give a position several times
    doc = Window.partitionBy("doc_id", "th").orderBy("pos")
    runs = dropped.withColumn("run", F.col("pos") - F.row_number().over(doc)).groupBy("doc_id", "th", "run").agg(F.min("pos").alias("at"), F.count(F.lit(1)).cast("int").alias("drop"))
    gap = F.col("at") - F.coalesce(F.lag(F.col("at") + F.col("drop")).over(Window.partitionBy("doc_id", "th").orderBy("at")), F.lit(0))
    runs = runs.withColumn("keep", gap.cast("int"))
    packed = runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("at", "keep", "drop"))).alias("runs"))
    return packed.select("doc_id", F.col("th").alias("text_hash"), F.transform("runs", lambda r: F.struct(r["keep"].alias("keep"), r["drop"].alias("drop"))).alias("runs"))


def _mask(runs: Column, n: Column) -> Column:
    """'1' per kept line, '0' per dropped one."""
    parts = F.transform(runs, lambda r: F.concat(F.repeat(F.lit("1"), r["keep"]), F.repeat(F.lit("0"), r["drop"])))
    return F.rpad(F.array_join(parts, ""), n, "1")


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """`docs` with text replaced by its kept lines, and the columns n_lines, n_dropped and runs (the bitmap)."""
    th, runs, other = (fresh(docs, c) for c in ("line_text_hash", "line_runs", "line_doc_id"))
    maps = line_bitmaps(docs, min_docs, keep).select(F.col("doc_id").alias(other), F.col("text_hash").alias(th + "_b"), F.col("runs").alias(runs))
    left = docs.withColumn(th, F.xxhash64("text"))
    joined = left.join(maps, left["doc_id"].eqNullSafe(maps[other]) & (left[th] == maps[th + "_b"]), "left")
    lines = lines_of(F.col("text"))
    n = F.size(lines)
    flags = F.split(_mask(F.col(runs), n), "")
    kept = F.array_join(F.filter(F.zip_with(lines, flags, lambda x, f: F.when(f == "1", x)), lambda x: x.isNotNull()), "\n")
    dropped = F.coalesce(F.aggregate(F.col(runs), F.lit(0).cast("bigint"), lambda s, r: s + r["drop"]), F.lit(0).cast("bigint"))
    out = {"n_lines": n.cast("bigint"), "n_dropped": dropped, "runs": F.col(runs), "text": F.when(F.col(runs).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)}
    return joined.select(*[c for c in docs.columns if c.lower() not in out], *[v.alias(k) for k, v in out.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs, min_docs=10, keep="none")
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE hot.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY doc_id
"""
