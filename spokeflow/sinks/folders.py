"""Folders of writes, numbered by micro-batch (``batch=<id>``, also ``batch=<id>-<attempt>``), on any file system that Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _found(spark: SparkSession, path: str, end: str):
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*{end}")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, [f.getPath() for f in files.globStatus(pattern) or []]


def _number(path) -> int:
    return int(path.getName().split("=")[1].split("-")[0])


def finished(spark: SparkSession, path: str) -> list[int]:
    """Ids of the folders ``batch=<id>`` whose write was committed."""
    return sorted(_number(f.getParent()) for f in _found(spark, path, "/_SUCCESS")[1])


def numbered(spark: SparkSession, path: str) -> list[int]:
    """Ids of the folders ``batch=<id>``, as a write that is partitioned by ``batch`` leaves them."""
    return sorted(map(_number, _found(spark, path, "")[1]))


def move(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder as a whole; ``target`` must not be there."""
    source, goal = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(goal.getParent())
    if files.exists(goal) or not files.rename(source, goal):
        raise OSError(f"{path} could not be moved to {target}")


def remove_below(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the folders with smaller ids."""
    files, found = _found(spark, path, "")
    for folder in found:
        if _number(folder) < batch_id:
            files.delete(folder, True)
