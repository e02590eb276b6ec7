"""Small files beside the tables: read, listed and renamed into place through Hadoop's file systems, which know every store that Spark can write to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    p, fs = located(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = located(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a file and rename it into place; fails if there is one of the name, for then another writer was first."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    temp, fs = located(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = located(spark, f"{folder}/{name}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(temp, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
