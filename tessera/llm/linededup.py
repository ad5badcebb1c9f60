"""Line dedup by site-relative frequency, with DataFrame operations only.

Pages are grouped by host. For each host and distinct line, the pages that hold the line are counted and
divided by the pages of the host; a line whose ratio exceeds ``max_ratio`` on at least ``min_pages`` pages
is boilerplate of that host and is dropped from its pages.

Lines are counted as 64-bit hashes, so that the shuffle carries 16 bytes a line and texts stay where they
are. Fewer than (mean lines of a page) / max_ratio lines of a host can be boilerplate, whatever the host's
size, so the list that is joined back by host is bounded by the lines of a page and not by the data. Both
joins by host read stored tables: Spark broadcasts those only below its size threshold and else splits the
partitions of hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, renamed, stored


def _line_keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """One row for each host that has boilerplate: host (may be null) and the hashes of its lines."""
    pages = stored(docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages")), "host-pages")
    lines = docs.select(F.col(host).alias("host"), F.explode(F.array_compact(F.array_distinct(_line_keys(F.col("text"))))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("holds")).filter(F.col("holds") >= min_pages)
    near = F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.holds") > F.col("b.pages") * max_ratio)
    return often.alias("a").join(pages.alias("b"), near).groupBy(F.col("a.host").alias("host")).agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """The documents without boilerplate lines, with n_lines and n_dropped, which replace columns of these names.

    A null text stays null and counts as a page with no line; an empty text stays empty. Blank lines are
    never counted nor dropped. A null host is a host of its own. Repeated rows are pages of their own. An
    empty table gives no rows. Other columns pass through.
    """
    prepare(docs.sparkSession)
    found = stored(boilerplate(docs, host, max_ratio, min_pages), "boilerplate")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")])
    rows, names = renamed(docs)
    joined = rows.join(found, F.col(names[host]).eqNullSafe(F.col("host")), "left")
    own, bad = F.col(names["text"]), F.coalesce("lines", F.array().cast("array<bigint>"))
    lines = F.split(own, "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(bad, F.xxhash64(x)))
    joined = joined.select(*names.values(), F.size(lines).alias("_all"), F.when(F.size(bad) > 0, kept).alias("_kept"))
    text = F.when(F.col("_kept").isNull(), own).otherwise(F.array_join("_kept", "\n"))
    count = F.when(own.isNull(), 0).otherwise(F.col("_all"))
    dropped = F.when(F.col("_kept").isNull() | own.isNull(), 0).otherwise(F.col("_all") - F.size("_kept"))
    columns = [(text if c == "text" else F.col(k)).alias(c) for c, k in names.items()]
    return joined.select(*columns, count.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
