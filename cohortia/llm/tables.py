"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from cohortia.session import cut_lineage, shared_dir

#: A table is handed to every task only if it is proven to be no larger than this.
SMALL_BYTES = 8 << 20


#: Rows and bytes of text that travel to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and a batch exists on both sides of the pipe.

    Lowers the session's own limits where they are higher; results do not depend on them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most or int(now) == 0:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps start there."""
    return cut_lineage(df)


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    system, at = _hadoop(spark, path)
    system.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of this name? Asked of the file system Spark reads it with."""
    system, at = _hadoop(spark, path)
    return system.exists(at)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path inside it; works in any task."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a binary column; a null is empty, bytes that are no UTF-8 become U+FFFD."""
    return [b.decode("utf-8", "replace") if b else "" for b in column.to_pylist()]
