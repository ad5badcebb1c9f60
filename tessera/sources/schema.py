"""Types that a table may hold, and the order of its columns."""

from __future__ import annotations

from pyspark.sql import types as T

INDEXABLE = (T.IntegerType, T.LongType, T.StringType, T.DateType, T.TimestampType, T.BooleanType, T.ShortType, T.ByteType)
INDEXED = "indexed"


def check(schema: T.StructType, index: list[str], partition_by: list[str], strict: bool = True) -> None:
    """Raise ValueError unless the columns can be written with this index."""
    data = [f for f in schema.fields if f.name not in partition_by]
    if not data:
        raise ValueError("All columns are partition columns; a table needs another one")
    missing = [c for c in index if c not in {f.name for f in data}]
    if missing:
        raise ValueError(f"There is no data column {missing[0]} to index")
    for f in data:
        if not isinstance(f.dataType, INDEXABLE) and (strict or f.name in index):
            raise ValueError(f"Column {f.name} of type {f.dataType.simpleString()} can't be {'indexed' if f.name in index else 'stored'}")


def ordered(schema: T.StructType, index: list[str], partition_by: list[str]) -> T.StructType:
    """Index columns in the order given, then the other data columns, then partition columns."""
    by = {f.name: f for f in schema.fields}
    names = [*index, *(n for n in schema.names if n not in index and n not in partition_by), *partition_by]
    fields = []
    for n in names:
        f = by[n]
        fields.append(T.StructField(n, f.dataType, f.nullable, {**(f.metadata or {}), **({INDEXED: True} if n in index else {})}))
    return T.StructType(fields)


def index_of(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if (f.metadata or {}).get(INDEXED)]
