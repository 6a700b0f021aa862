"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "strictpast", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Parquet grows in memory: without this the planner takes compressed file sizes for
        # row sizes and broadcasts tables that are not small.
        .config("spark.sql.sources.fileCompressionFactor", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder: executors on other machines could not read one.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch area and return a scan of the written table.

    Used where several passes read one intermediate result. Unlike a cached frame, the
    table survives lost executors, is column-pruned per pass, and its size on storage is
    known to the planner, so a later join broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``. Tables lie in a folder per application, so a
    finished run's scratch data can be dropped as a whole.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/staged/{run}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
