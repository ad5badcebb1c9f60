"""Streams over indexed tables: Spark's own streaming over a table's files, with the schema of its sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import quoted
from ..sources import tables


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of a table's rows, as files arrive."""
    reader = spark.readStream.schema(tables.table_schema(spark, path))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def windowed_counts(rows: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows counted by windows of time and other columns: start, the columns and n; rows later than ``late`` are dropped.

    The state is a row for each window and combination of columns that the watermark hasn't passed.
    """
    window = F.window(F.col(quoted(time)), width)
    return rows.withWatermark(time, late).groupBy(window, *map(quoted, keys)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *map(quoted, keys), "n")
