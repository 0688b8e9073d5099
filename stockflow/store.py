"""Materialisation and versioned publishing of state tables (section 7.2).

* :func:`materialize` cuts lineage at a stage boundary with files in the shared
  ``spark.checkpoint.dir`` (never a local checkpoint), so a lost executor
  recomputes from them, not from the sources, and later plans stay small.
  :func:`scratch` deletes those of a step whose results are published.
* :class:`TableStore` publishes all outputs of a batch together: append
  tables are written to ``<table>/batch_id=<n>/`` (overwriting only that
  partition, so replaying a batch is a no-op) and state tables to
  ``<table>/v=<n>/``; a small numbered manifest naming the current versions
  is written last and renamed into place. Readers resolve through the highest,
  so the event rows, ledger, stock and owed jobs of a batch become visible
  at once. On object stores use a table format with atomic commits instead;
  this module is the only place that knows the layout.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stockflow.session import checkpoint_dir


#: What Parquet files give back as it was.
_PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _storable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        names = {n.lower() for n in kind.names}
        return 0 < len(names) == len(kind.names) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return isinstance(kind, _PLAIN)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; else they lie on the
    executors' disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as compressed columns in the cluster's shared checkpoint folder,
    written now: a third of a checkpoint's size, and a reader takes the columns
    it needs. What Parquet does not hold (void, intervals, names that come
    twice) is checkpointed. The files stay until :func:`scratch` or
    :func:`release` deletes them."""
    spark = df.sparkSession
    if not _storable(df.schema):
        return checkpointed(df)
    path = os.path.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(out)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, which Spark itself deletes once nothing
    refers to it: for the versions of a table that a long-lived object replaces."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCOPES = threading.local()


@contextmanager
def scratch() -> Iterator[list]:
    """The tables cut inside (in this thread, by no scope further in) are deleted
    at its end. What goes on beyond it must not read them; :func:`keep` takes a
    table out."""
    made: list = []
    _SCOPES.open = [*getattr(_SCOPES, "open", []), made]
    try:
        yield made
    finally:
        _SCOPES.open = [s for s in _SCOPES.open if s is not made]
        release(*made)


def keep(made: list, *tables: DataFrame) -> None:
    """``tables`` outlive the scope ``made`` of :func:`scratch`."""
    made[:] = [t for t in made if not any(t is k for k in tables)]


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` cut; others are left alone."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path:
            spark = table.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join for which both sides are dealt out by key.

    For tables that grow with the catalogue or the jobs. Left alone, Spark
    judges them by their compressed files, or by estimates from those, and
    gathers in the driver what is many times as large once it is read.
    """
    return df.hint("merge")


class TableStore:
    """Versioned tables under one root folder with numbered manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- manifest ---------------------------------------------------------
    def _hadoop_fs(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), jvm

    def _manifests(self, fs, jvm) -> dict:
        """Path by number of every manifest; the highest is in force."""
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest-*.json")) or []
        paths = [s.getPath() for s in found]
        return {int(p.getName().removeprefix("_manifest-").removesuffix(".json")): p for p in paths}

    def manifest(self) -> dict:
        fs, jvm = self._hadoop_fs()
        known = self._manifests(fs, jvm)
        if not known:
            return {"last_batch": -1, "tables": {}}
        stream = fs.open(known[max(known)])
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            text = "".join(iter(reader.readLine, None))
        finally:
            stream.close()
        return json.loads(text)

    def _write_manifest(self, m: dict) -> None:
        """A new number under a temporary name, then one rename: a crash
        leaves the former manifest in force."""
        fs, jvm = self._hadoop_fs()
        number = max(self._manifests(fs, jvm), default=0) + 1
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(m, sort_keys=True).encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest-{number:012d}.json")):
            raise OSError(f"manifest {number} exists: another writer is at work")

    # -- read / write -----------------------------------------------------
    def path(self, table: str, m: dict | None = None) -> str | None:
        m = m or self.manifest()
        entry = m["tables"].get(table)
        if entry is None:
            return None
        if entry["kind"] == "state":
            return f"{self.root}/{table}/v={entry['version']}"
        return f"{self.root}/{table}"

    def read(self, table: str, schema=None) -> DataFrame | None:
        m = self.manifest()
        p = self.path(table, m)
        if p is None:
            return None
        entry = m["tables"][table]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        fs, jvm = self._hadoop_fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(p)):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(p)
        if entry["kind"] == "append":
            df = df.filter(df["batch_id"] <= m["last_batch"])
        return df

    def publish(self, batch_id: int, state: dict[str, DataFrame] | None = None,
                append: dict[str, DataFrame] | None = None, split: dict[str, list[str]] | None = None) -> bool:
        """Write every output of ``batch_id`` then flip the manifest.

        ``split``: columns by which an append table is partitioned before its batch.

        Returns False (and writes nothing) when the batch was already
        published - the idempotence ``foreachBatch`` needs on replay.
        """
        m = self.manifest()
        if batch_id <= m["last_batch"]:
            return False
        with freed_shuffles(self.spark):
            for name, df in (append or {}).items():
                out = df.selectExpr("*", f"CAST({int(batch_id)} AS BIGINT) AS batch_id")
                (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy(*(split or {}).get(name, []), "batch_id").parquet(f"{self.root}/{name}"))
                m["tables"][name] = {"kind": "append", "schema": out.schema.json()}
            for name, df in (state or {}).items():
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={int(batch_id)}")
                m["tables"][name] = {"kind": "state", "version": int(batch_id), "schema": df.schema.json()}
        m["last_batch"] = int(batch_id)
        self._write_manifest(m)
        return True


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for query outputs under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
