import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts; ids count from 0 unless given."""

    def make(texts, ids=None, **extra):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, DOC)
        for name, value in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make


#: Names that operators use inside: a table that has them as columns must work.
CLASH = {c: "mine" for c in ("th", "key", "part", "runs", "id", "n", "regs", "start", "matches", "overlaps", "toxicity_score", "label", "line_runs", "near_dup_id", "h1", "salt", "bits", "one", "revisit")}
