"""Scans over indexed tables with predicates as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import filters
from ..sources import tables


def planned(spark: SparkSession, path: str, predicate: filters.Predicate) -> filters.Plan:
    """How a scan of a table by a predicate is planned."""
    return filters.plan(predicate, tables.table_schema(spark, path), tables.table_index(spark, path))


def scan(spark: SparkSession, path: str, predicate: filters.Predicate | None = None, columns: list[str] | None = None, two_valued: bool = False, pushdown: bool = True) -> DataFrame:
    """The rows of a table that match a predicate, with the columns asked for, in that order.

    A predicate that folds to a constant becomes no filter at all, or an empty relation without a scan. What
    it says of the index alone is handed to the reader as a filter of its own where the whole can't be: in
    two-valued logic, whose comparisons readers don't take. ``pushdown=False`` hands the reader no filter.
    """
    df = tables.read_indexed(spark, path, pushdown=pushdown)
    if predicate is not None:
        found = filters.plan(predicate, df.schema, tables.table_index(spark, path))
        if found.known is None:
            if two_valued and filters.state(found.index_tree) is None and filters.positive(found.index_tree):
                df = df.filter(filters.to_column(found.index_tree))
            df = df.filter(filters.to_column(found.tree, two_valued))
        elif not found.known:
            df = df.filter("false")
    return df if columns is None else df.select(*map(filters.quoted, columns))
