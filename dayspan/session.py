"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "dayspan", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Session with the settings the operators rely on (AQE, UTC, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the Python call site of every Column call takes longer than planning the query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for written stages: the one the cluster names, else a temporary one in local mode.

    A machine-local folder is only ever chosen when the master is local, because
    executors on other machines could not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="dayspan-"))
    return context.getCheckpointDir()


def new_stage_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/dayspan/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage, survives the loss of executors and, unlike an RDD checkpoint,
    keeps column pruning and filter push-down for the readers. ``tasks`` is the most tasks that write, each one file:
    a small result of many partitions would take the executors longer to open files than to fill them.
    """
    path = new_stage_path(df.sparkSession, label)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def stage_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table in buckets of ``key``: grouping and joining by it need no shuffle any more.

    ``df`` should come hash-partitioned by the key into as many parts, which gives one file per bucket.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    staged = spark.table(name)
    staged.stage_path, staged.stage_table = path, name
    return staged


def release(*staged: DataFrame) -> None:
    """Delete the files of staged tables that no later result reads."""
    for df in staged:
        if hasattr(df, "stage_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stage_table}")
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
