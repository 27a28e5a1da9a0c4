"""Session defaults, the shared scratch folder, and small sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Scratch folders of local sessions without a configured one, by application.
_OWN_ROOTS: dict[str, str] = {}


def local_session(app: str = "labelloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local master without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_ROOTS:
        _OWN_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="labelloom-")
    return _OWN_ROOTS[context.applicationId]


def session_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/labelloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{session_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that read them end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(session_scratch(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The table outlives executors, keeps per-row values such as partition-based
    numbers fixed, and lets later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_lookup(df: DataFrame) -> DataFrame:
    """Compute a side that should be small once, as a scratch table.

    The size of its files tells the planner whether to broadcast it or to join by shuffle.
    """
    return materialize(df, "lookup")
