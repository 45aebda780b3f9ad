"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Scratch paths of this driver, in order; what discard_since() deletes is taken out.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can read: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder that goes when Python ends. A cluster
    has no such folder, so there it must be set.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="parqlane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/parqlane/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """A place in the list of scratch paths, for discard_since()."""
    return len(_made)


def discard_since(spark: SparkSession, place: int, keep: DataFrame) -> None:
    """Delete what was written below the shared folder since mark(), but for what materialise() wrote for ``keep``."""
    for path in _made[place:]:
        if path != keep._scratch:
            file_system(spark, path)[0].delete(hadoop_path(spark, path), True)
    _made[place:] = [keep._scratch]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what materialise() wrote for df; the frame cannot be read afterwards."""
    path = getattr(df, "_scratch", None)
    if path:
        file_system(df.sparkSession, path)[0].delete(hadoop_path(df.sparkSession, path), True)


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    p = hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
