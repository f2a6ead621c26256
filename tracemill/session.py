"""Session helpers: where shared files go, and how lineage is cut.

Nothing here writes to a machine-local folder on a cluster: the shared folder is the one the
session names in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests, a
laptop) is a temporary folder created and registered; elsewhere that is an error. What was written is
deleted when the driver ends, or by ``drop_written``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(path)
        return path
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tracemill-")
    sc.setCheckpointDir(path)
    return path


_WRITTEN: list[tuple[SparkSession, str]] = []


def drop_written(since: int = 0, keep: int = 0) -> None:
    """Delete the tables that this driver wrote to the shared folder after the mark ``since`` (see ``mark``), but for the last ``keep``.

    Nothing that reads them may run after it.
    """
    old = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for spark, path in old:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the context is gone; the folder's owner clears what is left
            return


def mark() -> int:
    """A mark for ``drop_written``: how many tables have been written."""
    return len(_WRITTEN)


atexit.register(drop_written)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Cache with spilling; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def sized_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast hint only if the counted rows are within ``limit``; else the plain side."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
