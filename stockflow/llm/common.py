"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import checkpoint_dir

#: Words of the contracts: runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Folders written by :func:`cut` in this process, oldest first.
_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read instead of a recomputation, and the
    columnar files keep column pruning. The folder lives until
    :func:`sweep` (or whatever cleans the cluster's checkpoint folder).
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Position in the list of scratch folders, for :func:`sweep`."""
    return len(_SCRATCH)


def sweep(spark: SparkSession, start: int, stop: int) -> None:
    """Delete the scratch folders made between two marks.

    Only for results that have been written elsewhere: frames built on the
    folders can no longer be read afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i in range(start, stop):
        if _SCRATCH[i]:
            path = jvm.org.apache.hadoop.fs.Path(_SCRATCH[i])
            path.getFileSystem(conf).delete(path, True)
            _SCRATCH[i] = ""


def words_of(text: Column) -> Column:
    """Array of words of ``text``; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def null_key(c: Column) -> Column:
    """A non-null string key that keeps null apart from every value."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def python_path(spark: SparkSession) -> None:
    """Prepare a session for this package's Python tasks.

    Local Python workers can import the package as the driver does (on a
    cluster it is shipped with ``--py-files`` as usual). Texts are large rows:
    unless the user has set a batch size, Arrow batches hold 2,000 of them.
    """
    import os

    import stockflow

    root = os.path.dirname(os.path.dirname(os.path.abspath(stockflow.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, "10000") == "10000":
        spark.conf.set(size, "2000")


def settled(run):
    """``run`` over a task's batches, then unused memory goes back to the
    system: workers are reused and idle ones should hold little."""
    def wrapped(batches):
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return wrapped
