"""Shared pieces of the text operators: shared storage, safe names, skew-proof key lookups."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.storage import discard, materialize, scratch_path, shared_dir

__all__ = ["SALTS", "ascii_lower", "discard", "free_shuffles", "fresh", "give_back", "materialize", "read_table", "salt", "salt_mask", "salts_of", "scratch_path", "shared_dir"]

#: Parts that a hot key is dealt into. A power of two, 32 at most (a bit mask records the parts in use).
SALTS = 32

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system: workers outlive their tasks, and what they keep counts while others run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of `df` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def salt(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(SALTS)).cast("int")


def salt_mask(salt_col: Column) -> Column:
    """Aggregates the salts in use to one bigint."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt_col))


def salts_of(mask: Column) -> Column:
    """The salts in a mask, as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", mask, i) == 1)
