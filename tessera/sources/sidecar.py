"""The file beside a table's part files that keeps its schema, index and properties.

It is written and read by the driver through Hadoop's file systems, so it lies wherever the table lies, and
its name begins with an underscore, so Spark's file listing passes over it.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

NAME, VERSION = "_tessera.json", 1


def place(spark: SparkSession, path: str):
    """A path, and its file system, of Hadoop's."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _place(spark: SparkSession, path: str, name: str = NAME):
    return place(spark, path.rstrip("/") + "/" + name)


def write(spark: SparkSession, path: str, schema: T.StructType, **facts) -> None:
    """Put the sidecar in place in one rename."""
    text = json.dumps({"version": VERSION, "schema": json.loads(schema.json()), **facts}, sort_keys=True)
    final, fs = _place(spark, path)
    temporary, _ = _place(spark, path, f"_tmp{NAME}")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(temporary, final):
        raise OSError(f"{final} can't be written")


def read(spark: SparkSession, path: str, ignore_missing: bool = True) -> dict | None:
    """The facts of a table, its schema as a StructType; None if there is no sidecar and that may be."""
    found, fs = _place(spark, path)
    if not fs.exists(found):
        if ignore_missing:
            return None
        raise FileNotFoundError(str(found))
    stream = fs.open(found)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    facts = json.loads(text)
    if facts["version"] > VERSION:
        raise ValueError(f"{found} has version {facts['version']}; this library reads up to {VERSION}")
    facts["schema"] = T.StructType.fromJson(facts["schema"])
    return facts


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a table's path."""
    found, fs = _place(spark, path)
    return fs.exists(found.getParent()) and len(fs.listStatus(found.getParent())) > 0
