"""Tables between steps: the shared checkpoint folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side is sent to every executor.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that
    is unset and the master is local (tests), a new temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fluxpanel-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_FOLDERS: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """This application's folder of written tables, deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/fluxpanel/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = folder
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        # Hadoop deletes it as the driver's JVM ends, also after an error.
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Writes `df` once to the shared folder and returns it as read from there.

    That cuts the lineage: lost executors cost a re-read, not a recomputation,
    and what a second pass reads is what the first pass wrote.  Tables that no
    `discard` deletes earlier go when the driver ends."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` wrote and that nothing reads any more.
    What a returned DataFrame still reads stays in the shared folder."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df` for broadcasting if its counted `rows` are within `limit`;
    beyond it the join stays a shuffled one, which has no size limit."""
    return F.broadcast(df) if rows <= limit else df
