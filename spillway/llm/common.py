"""Shared plumbing: scratch tables in the folder the cluster shares, Arrow batch limits, hot-key helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: texts are handed to Python in slices of bounded memory.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a new one of its own (tests); a cluster's executors couldn't reach that.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


@lru_cache(1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spillway-")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spillway/{uuid.uuid4().hex}-{name}"


_scopes = threading.local()


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if getattr(_scopes, "held", None):
        _scopes.held[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    """Folders of the shared one."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables and archives made inside, by this thread, are deleted at the end; what is taken out of the list stays.

    Results of the operators are lazy and read such tables: write them out before the end.
    """
    _scopes.held = [*getattr(_scopes, "held", []), made := []]
    try:
        yield made
    finally:
        _scopes.held = _scopes.held[:-1]
        delete(spark, *made)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless the user has bounded them lower."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that extra columns with clashing names can't meddle."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
