"""The few file operations a store needs beside Spark's readers and writers, on any file system Spark knows."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it does not exist."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist; False if it does.

    One of several writers succeeds, as far as the file system's exclusive
    create is atomic (HDFS, object stores with conditional puts).
    """
    fs, where = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    out.writeUTF(text)
    out.close()
    return True


def read_once(spark: SparkSession, path: str) -> str | None:
    """The text of a file made by ``create_once``; None if there is none."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds, if it exists."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
