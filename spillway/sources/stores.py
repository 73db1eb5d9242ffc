"""Places that driver and executors share: paths and URLs, small text files, and tables in versions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

VERSION = re.compile(r"v-(\d{8})")


def is_url(path: str) -> bool:
    return re.match(r"\w[\w+.-]*:", path) is not None


def whole_path(path: str) -> str:
    """A URL as it is, a path of this machine in full; without a slash at the end."""
    path = str(path)
    return (path if is_url(path) else str(Path(path).expanduser().resolve())).rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The JVM, the file system of a path, and the path there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    _, files, where = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


class TextFile:
    """A small text, replaced as a whole: a file of this machine, or of any store that Spark reaches."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = str(path), spark
        if is_url(self.path) and spark is None:
            raise ValueError(f"{self.path} needs a session")

    def read(self) -> str | None:
        if not is_url(self.path):
            try:
                return Path(self.path).read_text()
            except OSError:
                return None
        jvm, files, where = hadoop(self.spark, self.path)
        if not files.exists(where):
            return None
        given = files.open(where)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8")
        finally:
            given.close()

    def write(self, text: str) -> None:
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        if not is_url(self.path):
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
            Path(fresh).write_text(text)
            Path(fresh).replace(self.path)
            return
        jvm, files, where = hadoop(self.spark, self.path)
        out = files.create(jvm.org.apache.hadoop.fs.Path(fresh), True)
        out.write(bytearray(text.encode()))
        out.close()
        files.delete(where, False)
        files.rename(jvm.org.apache.hadoop.fs.Path(fresh), where)


def _complete(spark: SparkSession, base: str) -> list[int]:
    _, files, _ = hadoop(spark, base)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(m[1]) for n in names_in(spark, base) if (m := VERSION.fullmatch(n)) and files.exists(path(f"{base}/{n}/_SUCCESS")))


def current(spark: SparkSession, base: str) -> str | None:
    """The newest version that is whole."""
    found = _complete(spark, base)
    return f"{base}/v-{found[-1]:08d}" if found else None


def publish(spark: SparkSession, base: str, write: Callable[[str], None]) -> str:
    """A new version of a table or a group of tables, which readers see when it is whole; the version before stays for those that still read it."""
    _, files, _ = hadoop(spark, base)
    path = spark._jvm.org.apache.hadoop.fs.Path
    taken = [int(m[1]) for n in names_in(spark, base) if (m := VERSION.fullmatch(n))]
    number = max(taken, default=0) + 1
    fresh = f"{base}/v-{number:08d}"
    write(fresh)
    done = path(f"{fresh}/_SUCCESS")
    if not files.exists(done):
        files.create(done, True).close()
    for old in [n for n in _complete(spark, base) if n < number][:-1]:
        files.delete(path(f"{base}/v-{old:08d}"), True)
    return fresh


def write_table(df: DataFrame) -> Callable[[str], None]:
    return lambda path: df.write.mode("errorifexists").parquet(path)
