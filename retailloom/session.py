"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hash instead of sort a join side whose every partition turns out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("retailloom")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def submitted_session() -> SparkSession:
    """The session of a submitted program. What its user has set is left alone."""
    builder = SparkSession.builder.appName("retailloom").config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    given = dict(spark.sparkContext.getConf().getAll())
    for name, value in SETTINGS.items():
        if name.startswith("spark.sql.") and name not in given:
            spark.conf.set(name, value)
    return spark


_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets one temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="retailloom-")
    return _local_folders[context.applicationId]


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    _made.append(f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


@contextlib.contextmanager
def scratch_made():
    """Collect the paths of the intermediates that are named inside the block."""
    begin, paths = len(_made), []
    try:
        yield paths
    finally:
        paths.extend(_made[begin:])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediates that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    Cuts the lineage, survives executor loss, and gives the optimizer the real
    size of the result, so later joins broadcast it only if it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
