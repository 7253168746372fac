"""I-Match document fingerprints with randomised lexicons. DataFrame functions only.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Each term hashes to one of 2**`BITS` lexicon cells; the
document frequency of each cell is counted over the distinct texts of the corpus, and the lexicon keeps the cells whose inverse document
frequency ln(N / df) lies in `BAND`. A further lexicon keeps those outside the band that at most a share of `FURTHER` of the texts
hold. Both are bit sets of fixed size (32 kB each), whatever the corpus, so they may be broadcast.

A text's distinct terms are split over `SUBSETS` random parts of the lexicon. Each part has a chain of ever sparser random lexicons (a
quarter of the one before); the text uses the sparsest that still holds one of its terms, and the hash of the sorted list
of its terms in there is one of the fingerprint's hashes: short and long texts alike get lists of one to a few terms, so an
edit changes few of them. In a part where the text has no term in the band, its terms of the further lexicon stand in, and where it has none
of these either, its remaining ones: the words of a large group of near copies, which are in no band, still tell its
documents. Four hex digits per part; '----' where the text has no term. The likeness of two fingerprints is the share of equal hashes
among the parts that either text has.

Defined results: a null text counts as empty; a text without terms has '----' throughout and likeness 0 with all but an equal text that isn't empty (1). Rows
equal in doc_id and text are one document; a null doc_id counts as the least. Equal doc_ids are ordered by the hash of their
text. The next document of the last is the first; a single document is its own next. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callnet.llm.common import ascii_lower, free_shuffles, materialize, read_table

BITS = 18
SUBSETS = 64
#: Least and greatest ln(N / df) of a term that counts: not in over 2 % of the documents, in one of 50 million at least.
BAND = (math.log(50), math.log(50e6))

#: Terms in more than this share of the texts stand in last.
FURTHER = 0.5

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RANK_BITS = 58  # below the 6 bits that choose the subset
_TIER_BITS = 56  # of the rank, the 2 bits from here on say which lexicon holds the term: 0 the band's, 1 the further, 2 neither


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the terms (that of '' among them where the text begins or ends with a separator)."""
    return F.array_distinct(F.transform(F.split(ascii_lower(text), _SEPARATORS), lambda w: F.xxhash64(w)))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BITS) - 1))


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row: bits and further, array<bigint> each; bit i % 64 of element i / 64 says whether cell i is in the band or the further lexicon. `texts` has a column text."""
    spark = texts.sparkSession
    texts = texts.select(F.xxhash64("text").alias("th"), "text")
    n = texts.select("th").distinct().count()
    cells = texts.dropDuplicates(["th"]).select(F.explode(F.array_distinct(F.transform(term_hashes(F.col("text")), _cell))).alias("cell"))
    df = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("df"))
    blank = spark.range(1).select(_cell(F.xxhash64(F.lit(""))).alias("x")).first()[0]
    inside = (F.col("df") <= n / math.exp(band[0])) & (F.col("df") >= n / math.exp(band[1]))
    kept = df.where(F.col("cell") != blank).select("cell", inside.alias("inside"), (~inside & (F.col("df") <= n * FURTHER)).alias("beyond")).where("inside OR beyond")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("cell") % 64).cast("int"))
    words = kept.groupBy(F.shiftright("cell", 6).alias("w")).agg(F.bit_or(F.when(F.col("inside"), bit)).alias("b"), F.bit_or(F.when(F.col("beyond"), bit)).alias("f"))
    words = spark.range(1 << (BITS - 6)).select(F.col("id").alias("w")).join(words, "w", "left")
    words = words.select("w", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("b", "f")))
    rows = words.agg(F.array_sort(F.collect_list(F.struct("w", "b", "f"))).alias("rows"))
    return rows.select(F.transform("rows", lambda x: x["b"]).alias("bits"), F.transform("rows", lambda x: x["f"]).alias("further"))


def fingerprint(text: Column, bits: Column, further: Column | None = None) -> Column:
    """The fingerprint of a text column; bits, further: the lexicon's arrays, columns of the same row. Name all as plain columns."""

    def holds(lex: Column, h: Column) -> Column:
        word = F.element_at(lex, (F.shiftright(_cell(h), 6) + 1).cast("int"))
        return F.call_function("getbit", word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def tiered(h: Column) -> Column:
        own = h.bitwiseAND(F.lit(~(3 << _TIER_BITS)))
        tier = F.when(holds(bits, h), F.lit(0))
        if further is not None:
            tier = tier.when(holds(further, h), F.lit(1 << _TIER_BITS))
        return own.bitwiseOR(tier.when(h != F.xxhash64(F.lit("")), F.lit(2 << _TIER_BITS)))

    # '' is no term: null, unless the band holds it
    inside = F.filter(F.transform(term_hashes(text), tiered), lambda h: h.isNotNull())
    half = SUBSETS // 2
    rank = lambda h: h.bitwiseAND(F.lit((1 << _RANK_BITS) - 1))
    digits = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFF)))), 4, "0")
    gap = lambda n: F.repeat(F.lit("----"), n)

    def state(part, limit, hash_, out):
        return F.struct(part.cast("int").alias("part"), limit.cast("bigint").alias("limit"), hash_.cast("bigint").alias("hash"), out.alias("out"))

    def finished(s: Column) -> Column:
        return F.when(s["part"] < -half, s["out"]).otherwise(F.concat(s["out"], digits(s["hash"])))

    def step(s: Column, h: Column) -> Column:
        part = F.shiftright(h, _RANK_BITS).cast("int")
        low = h.bitwiseAND(F.lit((1 << _TIER_BITS) - 1))
        # no further than the terms of the same lexicon
        quarter = rank(h) - low + F.least(F.pow(F.lit(4.0), F.floor(F.log2(F.greatest(low, F.lit(1))) / 2) + 1), F.lit(2.0**_TIER_BITS)).cast("bigint")
        begun = state(part, quarter, F.xxhash64(h), F.concat(finished(s), gap(part - s["part"] - 1)))
        longer = state(s["part"], s["limit"], F.xxhash64(s["hash"], h), s["out"])
        return F.when(part != s["part"], begun).when(rank(h) < s["limit"], longer).otherwise(s)

    start = state(F.lit(-half - 1), F.lit(0), F.lit(0), F.lit(""))
    return F.aggregate(F.sort_array(inside), start, step, lambda s: F.concat(finished(s), gap(F.lit(half - 1) - s["part"])))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has terms; 0 if there are none."""
    part = lambda x, i: F.substring(x, i * 4 + 1, 4)
    used = F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0), lambda s, i: s + F.when((part(a, i) != "----") | (part(b, i) != "----"), 1).otherwise(0))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0), lambda s, i: s + F.when((part(a, i) != "----") & (part(a, i) == part(b, i)), 1).otherwise(0))
    return F.coalesce(F.try_divide(same.cast("double"), used.cast("double")), F.lit(0.0))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(texts, band).withColumn("one", F.lit(1))
    return texts.withColumn("one", F.lit(1)).join(F.broadcast(lex), "one").select("doc_id", fingerprint(F.col("text"), F.col("bits"), F.col("further")).alias("fingerprint"))


def next_documents(ids: DataFrame) -> DataFrame:
    """(d, th, n, next_d, next_th): the following document by descending d, th; after the last comes the first.

    A global lead without a global sort task: ids are dealt to ranges, each range is a window of its own, and only the
    first id of each range (one row per range) is put in order by itself.
    """
    dealt = materialize(ids.repartitionByRange(F.desc("d"), "th").withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range").orderBy(F.desc("d"), "th")
    inner = dealt.withColumns({"next_d": F.lead("d").over(own), "next_th": F.lead("th").over(own)})
    firsts = dealt.groupBy("range").agg(F.min(F.struct((-F.col("d")).alias("o"), "th", "d")).alias("f"))
    across = Window.orderBy("range")
    follow = firsts.select("range", F.lead("f").over(across).alias("follow"), F.first("f").over(across).alias("very_first"))
    follow = follow.select(F.col("range"), F.coalesce("follow", "very_first").alias("follow"))
    joined = inner.join(F.broadcast(follow), "range")
    last = F.col("next_th").isNull()
    return joined.select("d", "th", "n", F.when(last, F.col("follow.d")).otherwise(F.col("next_d")).alias("next_d"), F.when(last, F.col("follow.th")).otherwise(F.col("next_th")).alias("next_th"))


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness; see the query's contract in the README."""
    least = -(1 << 62)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    lex = materialize(lexicon(base.select("text"), band), "lexicon").withColumn("one", F.lit(1))
    order = materialize(next_documents(base.select("d", "th", F.char_length("text").cast("long").alias("n")).distinct()), "next")
    free_shuffles(docs.sparkSession)  # those of the lexicon
    # each text goes, once by its own id, to where its own edited text and that of the document before it are made
    asked = order.select(F.col("next_d").alias("d"), F.col("next_th").alias("th"), F.col("d").alias("to_d"), F.col("th").alias("to_th"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    heads = base.join(asked, ["d", "th"]).select(F.col("to_d").alias("d"), F.col("to_th").alias("th"), F.expr("left(text, half)").alias("head"))
    heads = heads.dropDuplicates(["d", "th"])
    joined = base.join(heads, ["d", "th"])
    joined = joined.select("d", "th", "text", F.char_length("text").alias("n"), "head")
    joined = joined.select("d", "th", "n", "text", F.concat(F.expr("left(text, n - CAST(floor(n / 2) AS INT))"), "head").alias("edited"), F.lit(1).alias("one"))
    joined = joined.join(F.broadcast(lex), "one")
    made = joined.select("d", "th", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), (F.col("text") == F.col("edited")).alias("unedited"), *(fingerprint(F.col(t), F.col("bits"), F.col("further")).alias(name) for t, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"))))
    made = materialize(made, "fingerprints")
    follower = made.select(F.col("d").alias("next_d"), F.col("th").alias("next_th"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["next_d", "next_th"])
    out = made.join(order.select("d", "th", "next_d", "next_th"), ["d", "th"]).join(follower, ["next_d", "next_th"])
    equal = lambda same: F.when(same & (F.col("n_chars") > 0), F.lit(1.0))
    return out.select(
        F.when(F.col("d") != least, F.col("d")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        equal(F.col("unedited")).otherwise(likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("near_edited"),
        equal(F.col("th") == F.col("next_th")).otherwise(likeness(F.col("fingerprint"), F.col("next_fingerprint"))).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))
