"""Session settings, table loading and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siltworks", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under; a cluster brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make a local one only on a local master, where the session names
    none.  A cluster without ``spark.checkpoint.dir`` is an error: its workers share no local folder."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"siltworks-checkpoints-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(path)


#: Spark's switch for deleting the shuffle files of a query as it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, partition_by: str | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return a frame that reads it.

    The files live in the reliable folder of ``spark.checkpoint.dir``, so a later stage survives
    the loss of an executor, and the plan is computed exactly once.  With ``partition_by`` a filter on
    that column reads only its files.  With ``free`` the shuffle files of the plan go as soon as the table is
    written, not when the driver next collects its garbage; the plan must not read persisted frames.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/table-{uuid.uuid4().hex}"
    w = df.write
    was = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE_SHUFFLES) if was is None else spark.conf.set(FREE_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)
