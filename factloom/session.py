"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; a running one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, as ``spark.checkpoint.dir`` or the context's checkpoint folder names it.

    Where neither is set, a local session (tests) gets a temporary folder; a cluster raises RuntimeError, for a folder of
    one machine would be missing on the others.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/factloom-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Losing an executor afterwards costs a re-read, not a recomputation, and plans know the table's size. The tables
    stay until :func:`release`.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that still read it must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
