"""Table access, lineage cuts and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``; columns are pruned and filters pushed by the caller's plan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer parts than there are cores, as for one small file with costly rows; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names, or the context's checkpoint folder.

    Where neither is set, a temporary folder serves a session in one process, as in tests; with executors of their own it is an error,
    as each would write to its own disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rookery-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder. For results far smaller than their input."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared one, deleted when the driver's JVM ends or by ``release``."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    _FOLDERS.append(path)
    return path


_FOLDERS: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes all intermediate folders of this process now; results that still read them are lost. The number of folders."""
    n = len(_FOLDERS)
    while _FOLDERS:
        at = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def written(df: DataFrame, what: str, by: Sequence[str] = ()) -> DataFrame:
    """Like ``checkpointed`` but columnar, in a ``new_folder``: later reads prune columns, and files by the columns ``by``."""
    path = new_folder(df.sparkSession, what) + "/rows"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
