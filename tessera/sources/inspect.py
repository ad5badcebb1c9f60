"""What a table's footers tell: its stripes, their statistics, and what a predicate would leave to read.

Footers are read where the files are listed to, one task a share of the files, and come back as rows; no
footer reaches the driver unless asked for. No column is read.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from . import bloom, scratch, sidecar, tables

STRIPES = "file string, stripe int, rows long, bytes long, column string, low string, high string, has_nulls boolean, known boolean, codec string"
INTEGERS = ("int", "bigint", "smallint", "tinyint")


def _open(uri: str):
    import pyarrow.fs as pafs

    fs, place = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))
    return fs.open_input_file(place)


def _utc(x: Any) -> Any:
    """A time as an instant of UTC; one without a zone is taken as Spark stores it, in UTC."""
    if not isinstance(x, datetime.datetime):
        return x
    return x.replace(tzinfo=datetime.timezone.utc) if x.tzinfo is None else x.astimezone(datetime.timezone.utc)


def _text(x: Any) -> str | None:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, datetime.datetime):
        return _utc(x).replace(tzinfo=None).isoformat(" ")
    return None if x is None else str(x)


def _bounds(chunk) -> tuple[Any, Any, bool | None, bool]:
    """Minimum and maximum of a column chunk, whether it holds nulls, and whether the first two tell all of its values."""
    s = chunk.statistics
    nulls = s.null_count if s is not None and s.has_null_count else None
    if s is not None and s.has_min_max:
        return s.min, s.max, None if nulls is None else nulls > 0, True
    return None, None, None if nulls is None else nulls > 0, nulls is not None and nulls == chunk.num_values


def _rows_of(uri: str) -> list[tuple]:
    import pyarrow.parquet as pq

    with _open(uri) as f:
        rows, meta = [], pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                chunk = group.column(c)
                low, high, nulls, known = _bounds(chunk)
                rows.append((uri, g, group.num_rows, group.total_byte_size, chunk.path_in_schema, _text(low), _text(high), nulls, known, chunk.compression))
    return rows


def _footers(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STRIPES.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
    for b in found:
        for uri in b.column(0).to_pylist():
            if rows := _rows_of(uri):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table, spread over tasks."""
    scratch.importable(spark)
    files = tables.read_indexed(spark, path).inputFiles()
    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(parts)


def stripes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk of each stripe: file, stripe, rows, bytes, column, low, high, has_nulls, known, codec.

    Bounds are text, times in UTC. Without ``known`` the footer has no bounds, as for very long texts.
    """
    return _files(spark, path).mapInArrow(_footers, STRIPES)


def _merged(rows: DataFrame, kinds: dict[str, str], *keys: str) -> DataFrame:
    """Bounds merged: minimum of minima, maximum of maxima, any nulls; null where some stripe's are not known."""
    whole = F.col("column").isin([c for c, k in kinds.items() if k in INTEGERS])
    known = F.bool_and("known")
    ends = {name: F.when(whole, best(F.expr(f"try_cast({name} AS bigint)")).cast("string")).otherwise(best(name)) for name, best in (("low", F.min), ("high", F.max))}
    ends = {name: F.when(known, x).alias(name) for name, x in ends.items()}
    return rows.groupBy(*keys).agg(*ends.values(), F.bool_or("has_nulls").alias("has_nulls"), known.alias("known"))


def _wanted(spark: SparkSession, path: str, columns: list[str] | None) -> dict[str, str]:
    facts = sidecar.read(spark, path)
    inside = facts["partition_by"] if facts else []
    kinds = {f.name: f.dataType.simpleString() for f in tables.table_schema(spark, path).fields if f.name not in inside}
    return kinds if columns is None else {c: kinds[c] for c in columns}


def file_stats(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Of each file and column, from footers: file, column, low, high, has_nulls, known. Partition columns are in no file."""
    kinds = _wanted(spark, path, columns)
    return _merged(stripes(spark, path).filter(F.col("column").isin(list(kinds))), kinds, "file", "column")


def table_stats(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The statistics of all files merged: column, low, high, has_nulls, known."""
    kinds = _wanted(spark, path, columns)
    return _merged(file_stats(spark, path, columns), kinds, "column")


def _instants(tree: filters.Predicate) -> filters.Predicate:
    """The tree with times as instants; one without a zone is local, as Spark takes it."""

    def leaf(x: filters.Predicate) -> filters.Predicate:
        instant = lambda v: v.astimezone(datetime.timezone.utc) if isinstance(v, datetime.datetime) else v
        if isinstance(x, filters.Compare):
            return replace(x, value=instant(x.value))
        return replace(x, values=tuple(map(instant, x.values))) if isinstance(x, filters.In) else x

    return filters.mapped(tree, leaf)


def _left(tree: filters.Predicate, kinds: dict[str, str], sketches: bool) -> Callable:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in found:
            for uri in b.column(0).to_pylist():
                with _open(uri) as f:
                    meta, kept = pq.ParquetFile(f).metadata, []
                    at = lambda start, size: f.read_at(size, start)  # noqa: B023, E731
                    size = f.size()
                    tail = struct.unpack("<I", at(size - 8, 4))[0]
                    places = bloom.places(at(size - 8 - tail, tail)) if sketches else []
                    for g in range(meta.num_row_groups):
                        group, stats = meta.row_group(g), {}
                        for c in range(group.num_columns):
                            chunk = group.column(c)
                            low, high, nulls, known = _bounds(chunk)
                            if chunk.path_in_schema in kinds and known and nulls is not None:
                                stats[chunk.path_in_schema] = (_utc(low), _utc(high), nulls)
                        tests = {c: bloom.test(at, p, kinds[c]) for c, p in (places[g] if sketches else {}).items() if c in kinds}
                        if filters.may_match(tree, stats, tests):
                            kept.append(g)
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(kept)), pa.array(kept, pa.int32())], names=["file", "stripe"])

    return run


def surviving_stripes(spark: SparkSession, path: str, tree: filters.Predicate, sketches: bool = True) -> DataFrame:
    """file and stripe of what statistics, and then the bloom filters of index columns, leave to read for a predicate.

    Tasks evaluate the predicate where they read the footers, so only what survives goes further. Column chunks
    that Parquet codes by a dictionary throughout have no bloom filter, so only their bounds count here.
    """
    schema = tables.table_schema(spark, path)
    tree = _instants(filters.simplify(filters.bind(tree, schema)))
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields if f.name in filters.columns(tree)}
    return _files(spark, path).mapInArrow(_left(tree, kinds, sketches), "file string, stripe int")


def surviving(spark: SparkSession, path: str, tree: filters.Predicate, sketches: bool = True) -> list[tuple[str, int]]:
    """The pairs of ``surviving_stripes``, in order; only these reach the driver."""
    return sorted((r["file"], r["stripe"]) for r in surviving_stripes(spark, path, tree, sketches).collect())


def rows_scanned(df: DataFrame) -> int:
    """Run a query, keeping no row, and give the rows that its file scans put out, after files and stripes were skipped."""
    done = df._jdf.queryExecution()
    done.toRdd().count()

    def walk(node) -> int:
        kids = node.children()
        inner = [kids.apply(k) for k in range(kids.size())]
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            inner = [node.executedPlan()]
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            inner = [node.plan()]
        here = node.metrics().apply("numOutputRows").value() if node.getClass().getSimpleName() == "FileSourceScanExec" else 0
        return here + sum(walk(k) for k in inner)

    return walk(done.executedPlan())
