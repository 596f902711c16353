"""What several operators of this subpackage share: reading tables, durable cuts of lineage, and word rules."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage are maximal runs of other characters than these six.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent (tests, local mode) a folder of this machine is chosen and kept for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='epochal-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove, spark, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one. It is removed when the driver ends."""
    path = f"{shared_dir(spark)}/epochal-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; whoever owns the shared folder cleans it
        pass


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage above the files, is computed once however often it is read, and survives lost executors.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand memory that a worker has freed back to the system, for the tasks of other operators and the JVM beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(docs: DataFrame, *labels: str) -> list[str]:
    """Names for columns of an operator's own, which no column of ``docs`` has in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for label in labels:
        name = f"_{label}"
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def without(docs: DataFrame, ids: DataFrame, columns: str | list[str] = "doc_id", most: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose ``columns`` are not among those of ``ids``.

    ``ids`` is written out and counted: up to ``most`` of them are broadcast, so the texts stay where they are; more are joined
    by a shuffle.
    """
    found = durable(ids.select(columns).distinct(), "ids")
    return docs.join(F.broadcast(found) if found.count() <= most else found, columns, "left_anti")
