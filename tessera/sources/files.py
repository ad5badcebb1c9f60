"""Single files: written and read one at a time, with a path instead of a table.

A file has stripes, statistics and sketches like the files of a table, and no sidecar; its index columns come first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters
from . import inspect, options, schema, sidecar, tables


@dataclass(frozen=True)
class Stripe:
    rows: int
    bytes: int
    columns: dict[str, tuple[str | None, str | None, bool | None]]  # low, high, has_nulls


@dataclass(frozen=True)
class FileInfo:
    path: str
    rows: int
    codecs: tuple[str, ...]
    schema: T.StructType
    stripes: tuple[Stripe, ...]


def write_file(df: DataFrame, path: str, *, index=(), compression: str | None = None, stripe_rows: int = options.STRIPE_ROWS, column_filters: bool = True, strict_types: bool = True, buffer_size: int = options.BUFFER, file_buffer: int | None = None) -> None:
    """Write all rows into one new file, by one task; FileExistsError if there is something at the path.

    Without ``compression`` the path's extension names the codec: .gz, .deflate, .snappy, any other none.
    """
    spark, index = df.sparkSession, options.index_columns(index)
    place, fs = sidecar.place(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    schema.check(df.schema, index, [], strict_types)
    wanted = schema.ordered(df.schema, index, [])
    out = df.select(*[F.col(filters.quoted(f.name)).alias(f.name, metadata=f.metadata) for f in wanted.fields]).coalesce(1)
    writer = tables.configured(out.write, wanted, index, options.codec(compression, path), options.stripe_rows(stripe_rows), column_filters, buffer_size, file_buffer)
    folder, _ = sidecar.place(spark, f"{place.getParent()}/_tmp-{uuid.uuid4().hex[:12]}")
    try:
        with tables.confs(spark, spark__sql__parquet__outputTimestampType="TIMESTAMP_MICROS"):
            writer.parquet(folder.toString())
        parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1 or not fs.rename(parts[0], place):
            raise OSError(f"{path} can't be written")
    finally:
        fs.delete(folder, True)


def read_file(spark: SparkSession, path: str, predicate: filters.Predicate | None = None, two_valued: bool = False) -> DataFrame:
    """The rows of a file, those that match a predicate if there is one."""
    df = spark.read.parquet(path)
    if predicate is None:
        return df
    found = filters.plan(predicate, df.schema, schema.index_of(df.schema))
    if found.known is not None:
        return df if found.known else df.filter("false")
    return df.filter(filters.to_column(found.tree, two_valued))


def file_info(spark: SparkSession, path: str, stripes: bool = True) -> FileInfo:
    """Rows, codecs and schema of a file, and its stripes with their bounds if wanted, from the footer alone."""
    by: dict = {}
    codecs = set()
    for r in inspect.stripes(spark, path).collect():  # one file's footer
        found = by.setdefault(r["stripe"], (r["rows"], r["bytes"], {}))
        found[2][r["column"]] = (r["low"], r["high"], r["has_nulls"])
        codecs.add(r["codec"])
    every = tuple(Stripe(*by[k]) for k in sorted(by))
    return FileInfo(path, sum(s.rows for s in every), tuple(sorted(codecs)), spark.read.parquet(path).schema, every if stripes else ())
