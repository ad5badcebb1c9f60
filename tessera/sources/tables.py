"""Writing and reading indexed tables.

A table is a folder of Parquet files and a sidecar. A stripe is a row group of at most ``stripe_rows`` rows;
its column chunks carry min, max and null counts, and those of index columns a bloom filter. Reading goes
through Spark's vectorised Parquet scan, so projections, filters and partition pruning reach the files.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import quoted
from . import options, schema, sidecar

PUSHDOWN = "spark.sql.parquet.filterPushdown"


@contextlib.contextmanager
def confs(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots may be __) that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pushdown(spark: SparkSession, enabled: bool):
    """Queries that run inside the block do or don't hand filters to the Parquet reader; results are the same.

    Frames are lazy, so what runs later follows the session again; ``read_indexed(pushdown=False)`` stays off.
    """
    return confs(spark, **{PUSHDOWN: str(enabled).lower()})


def without_pushdown(spark: SparkSession) -> SparkSession:
    """A session with the settings and views of this one, in which readers get no filters."""
    other = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    other.conf.set(PUSHDOWN, "false")
    return other


def configured(writer: DataFrameWriter, wanted: T.StructType, index: list[str], codec: str, rows: int, column_filters: bool, buffer_size: int, file_buffer: int | None) -> DataFrameWriter:
    """A writer of stripes and sketches."""
    writer = writer.option("compression", options.CODECS[codec]).option("parquet.block.row.count.limit", rows).option("parquet.page.size", options.buffer_size(buffer_size))
    if file_buffer is not None:
        writer = writer.option("io.file.buffer.size", options.file_buffer_size(file_buffer))
    for c in index if column_filters else ():
        if not isinstance(wanted[c].dataType, T.BooleanType):  # min and max tell all of a boolean
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", rows)
    return writer


def write_indexed(
    df: DataFrame, path: str, *, index=(), compression: str | None = "deflate", stripe_rows: int = options.STRIPE_ROWS, column_filters: bool = True,
    partition_by=(), mode: str = "error", properties: dict | None = None, strict_types: bool = True, cluster: bool = False, buffer_size: int = options.BUFFER, file_buffer: int | None = None,
) -> None:
    """Write a table whose columns are those of the index, in its order, then the others, then partition columns.

    Rows keep their order in each file unless ``cluster`` sorts each by the index. ``mode`` is Spark's; an
    append must agree with the table's schema and index. ``strict_types`` allows the eight indexable types
    only; without it other types may be data columns. ``deflate`` is Parquet's gzip. ``file_buffer`` sets
    ``io.file.buffer.size`` for the files written. An empty frame gives an empty table that can be read.
    """
    spark = df.sparkSession
    index, parts = options.index_columns(index), options.index_columns(partition_by)
    name, rows = options.codec(compression, path), options.stripe_rows(stripe_rows)
    kept = options.properties(properties)
    if mode not in ("error", "errorifexists", "overwrite", "append", "ignore"):
        raise ValueError(f"Unknown save mode: {mode}")
    for p in parts:
        if p not in df.columns:
            raise ValueError(f"There is no column {p} to partition by")
    schema.check(df.schema, index, parts, strict_types)
    wanted = schema.ordered(df.schema, index, parts)
    there = mode in ("append", "ignore") and sidecar.exists(spark, path)
    if there and mode == "ignore":
        return
    if there:
        old = sidecar.read(spark, path)
        shape = lambda s: [(f.name, f.dataType) for f in s.fields]
        if old and (shape(old["schema"]) != shape(wanted) or old["index"] != index or old["partition_by"] != parts):
            raise ValueError("The table has other columns or another index than what is appended")
    out = df.select(*[F.col(quoted(f.name)).alias(f.name, metadata=f.metadata) for f in wanted.fields])
    if cluster and index:
        out = out.sortWithinPartitions(*map(quoted, index))
    writer = configured(out.write.mode(mode), wanted, index, name, rows, column_filters, buffer_size, file_buffer)
    if parts:
        writer = writer.partitionBy(*parts)
    # Timestamps in the legacy INT96 form have no statistics that readers use.
    with confs(spark, spark__sql__parquet__outputTimestampType="TIMESTAMP_MICROS"):
        writer.parquet(path)
    if not there:
        sidecar.write(spark, path, wanted, index=index, partition_by=parts, codec=name, stripe_rows=rows, column_filters=bool(column_filters and index), properties=kept)


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema in the sidecar, or else that of the Parquet files."""
    facts = sidecar.read(spark, path)
    return facts["schema"] if facts else spark.read.parquet(path).schema


def table_index(spark: SparkSession, path: str) -> list[str]:
    """The index columns in the sidecar; none without one."""
    facts = sidecar.read(spark, path)
    return facts["index"] if facts else []


def read_indexed(spark: SparkSession, path: str, pushdown: bool = True) -> DataFrame:
    """A table; columns are found by name, so files with other orders of columns read alike.

    With ``pushdown=False`` the frame hands the reader no filters, whenever it runs; so it belongs to a
    session of its own, and of frames that are joined the left one's session counts.
    """
    spark = spark if pushdown else without_pushdown(spark)
    facts = sidecar.read(spark, path)
    if not facts:
        return spark.read.parquet(path)
    return spark.read.schema(facts["schema"]).parquet(path)


def table_properties(spark: SparkSession, path: str) -> dict[str, str]:
    return sidecar.read(spark, path, ignore_missing=False)["properties"]


def create_view(spark: SparkSession, name: str, path: str) -> None:
    """A temporary view for SQL, with the table's columns in the table's order."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in table_schema(spark, path).fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` ({columns}) USING parquet OPTIONS (path '{place}')")


def save_bucketed(
    df: DataFrame, name: str, buckets: int, columns, *, index=(), compression: str | None = "deflate", stripe_rows: int = options.STRIPE_ROWS, column_filters: bool = True,
    path: str | None = None, mode: str = "overwrite", properties: dict | None = None, strict_types: bool = False, buffer_size: int = options.BUFFER, file_buffer: int | None = None,
) -> str:
    """A catalogue table in buckets, for joins on the bucket columns without a shuffle; in the warehouse, or at ``path``.

    Returns where it lies. It has a sidecar as other tables have, so ``read_indexed`` and all inspection take
    that place; the catalogue's name is what joins without a shuffle need. ``mode``: overwrite, error or append.
    """
    spark, index, cols = df.sparkSession, options.index_columns(index), options.index_columns(columns)
    codec, rows, kept = options.codec(compression), options.stripe_rows(stripe_rows), options.properties(properties)
    if mode not in ("overwrite", "append", "error", "errorifexists"):
        raise ValueError(f"Unknown save mode for buckets: {mode}")
    schema.check(df.schema, index, [], strict_types)
    wanted = schema.ordered(df.schema, index, [])
    out = df.select(*[F.col(quoted(f.name)).alias(f.name, metadata=f.metadata) for f in wanted.fields])
    writer = configured(out.write.mode(mode).format("parquet"), wanted, index, codec, rows, column_filters, buffer_size, file_buffer)
    if path:
        writer = writer.option("path", path)
    with confs(spark, spark__sql__parquet__outputTimestampType="TIMESTAMP_MICROS"):
        writer.bucketBy(buckets, *cols).sortBy(*cols).saveAsTable(name)
    place = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]
    if mode != "append" or not sidecar.read(spark, place):
        sidecar.write(spark, place, wanted, index=index, partition_by=[], codec=codec, stripe_rows=rows, column_filters=bool(column_filters and index), properties=kept)
    return place


def metadata_count(spark: SparkSession, path: str, enabled: bool = True) -> int:
    """Number of rows from the files' footers, without reading a column; with ``enabled=False`` by an ordinary scan."""
    if not enabled:
        return read_indexed(spark, path).count()
    with confs(spark, spark__sql__sources__useV1SourceList="", spark__sql__parquet__aggregatePushdown="true"):
        return read_indexed(spark, path).agg(F.count("*")).first()[0] or 0
