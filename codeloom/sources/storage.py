"""Small files and folders in whatever store Spark writes to, through its own file systems."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    place, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new small file; False if there is one already."""
    place, fs = _place(spark, path)
    if fs.exists(place):
        return False
    try:
        out = fs.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; empty if it can't be read (any more)."""
    try:
        return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except PySparkException as e:
        if "PATH_NOT_FOUND" in str(e) or "FILE_NOT_EXIST" in str(e):
            return ""
        raise


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)
