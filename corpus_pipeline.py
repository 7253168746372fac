"""Training-corpus pipeline: toxicity, line deduplication, near-deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run` writes each
stage's result to the shared folder and reads it again, so a lost executor never sets the work back by more than a stage.

Defined results, for every stage: a null text counts as empty; a null doc_id is a value like any other in scores, lines and tiling, and is kept by
near-deduplication; repeated rows share their fate (near-deduplication keeps all rows of the doc_id it keeps); columns of any name pass
through; an empty table gives an empty table. Texts are processed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from callnet.llm.common import materialize, read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of 10 documents or more stays where it occurs first; documents of which nothing but blank lines is left thereby go."""
    done = line_dedup.dedup_lines(docs, min_docs=10, keep="first")
    left = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 80 %) the document with the least doc_id stays."""
    return near_dup.drop_near_duplicates(docs, k=5, similarity=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's words in runs of five or more go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages score, link and pack in ways that SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
