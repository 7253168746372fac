"""Tables written between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: dict[str, tuple[object, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master only: executors elsewhere couldn't see it."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="callnet-")
    return _own_dir


def _delete(path: str) -> None:
    fs, hadoop = _written.pop(path)
    try:
        fs.delete(hadoop, True)
    except Exception:  # the session has ended already
        return


def _drop_written() -> None:
    for path in list(_written):
        _delete(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/callnet/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not _written:
        atexit.register(_drop_written)
    _written[path] = fs, hadoop
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing will read again."""
    for t in tables:
        if t is not None and getattr(t, "written_to", None) in _written:
            _delete(t.written_to)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
