"""Session helpers: one place for configuration, table reading, checkpoints and intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "docloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (tests) is a temporary folder used instead; a cluster
    without the setting is an error, since its executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "docloom-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str = "snappy", rows: int | None = None, each: int = 200_000) -> DataFrame:
    """df written to a table of its own in the shared folder and read again.

    Like a checkpoint this cuts the lineage and survives lost executors, but columns are compressed, small files are
    read many to a task, and Spark knows the table's size when it plans a join. The table is marked for deletion at the
    session's end; forget() deletes it before. `rows`: no more rows than that are expected, so that at most one task for
    `each` of them writes the table, not one for each partition of the last shuffle.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read any more."""
    for df in tables:
        if df is not None:
            files, where = _files(df.sparkSession, df._docloom_path)
            files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffles and broadcasts of finished jobs now.

    It does so when the driver's collector finds that no plan refers to them; a driver with little garbage would hold
    them, and executors their files, for long.
    """
    gc.collect()
    spark._jvm.System.gc()
