"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cohortia", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session whose tasks run in this process may lack the setting, as in tests; it gets a
    temporary folder. Every other master must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cohortia.scratch.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="cohortia-")
    spark.conf.set("cohortia.scratch.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative operators call this so that a plan does not grow with the number of
    rounds and a lost executor only costs the current round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` itself if it was read back from ``cut_lineage``, else cut now.

    For operators that read their input several times, so that it is computed once however it is made.
    """
    return df if "_cut_path" in df.__dict__ else cut_lineage(df)


def forget(df: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote for ``df``, once nothing reads it any more.

    Loops call this for a round whose successor is written; a frame that was not cut is left alone.
    """
    path = df.__dict__.pop("_cut_path", None)
    if path is not None:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
