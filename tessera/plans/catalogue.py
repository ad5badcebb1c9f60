"""The registered queries over indexed tables and their SQL.

Each query writes the table it needs once a process and folder, and reads it back through the library.
"""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters as P
from ..operators import scan
from ..sources import files, inspect, scratch, tables
from ..streaming import read_stream, windowed_counts

_written: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str, index: str, shape=None, kind: str = "", **options) -> str:
    """The path of an indexed form of one of the tables in a folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, index, kind, *sorted((k, str(v)) for k, v in options.items()))
    if key not in _written:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        path = scratch.folder(spark, f"table-{name}")
        tables.write_indexed(shape(df) if shape else df, path, index=index, strict_types=False, **options)
        _written[key] = path
    return _written[key]


def _orders(spark, sf_dir, **options):
    return _table(spark, sf_dir, "orders", "o_custkey", **options)


def _lineitem(spark, sf_dir, index="l_orderkey,l_partkey", shape=None, kind="", **options):
    return _table(spark, sf_dir, "lineitem", index, shape, kind, **options)


def _part(spark, sf_dir, **options):
    return _table(spark, sf_dir, "part", "p_brand,p_size", **options)


def _with_nulls(spark, sf_dir):
    shape = lambda df: df.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return _table(spark, sf_dir, "orders", "o_orderstatus", shape, "nulls")


def _events(spark, sf_dir):
    # The files hold times without a zone, which readers don't prune on; as instants of UTC they do.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _table(spark, sf_dir, "events", "ts", lambda df: df.withColumn("ts", F.col("ts").cast("timestamp")), "instants")


def _days(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _table(spark, sf_dir, "events", "ts", lambda df: df.withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp"))), "days")


def _dated(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem", "l_shipdate", lambda df: df.withColumn("l_shipdate", F.col("l_shipdate").cast("date")), "dates")


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


ORDERS = "o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
LINE = "l_orderkey, l_partkey, l_linenumber, l_quantity"


@query(f"SELECT {ORDERS} FROM orders")
def scan_full(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir))


@query("SELECT l_quantity, l_partkey, l_returnflag, l_orderkey FROM lineitem")
def scan_project(spark, sf_dir):
    return scan(spark, _lineitem(spark, sf_dir), columns=["l_quantity", "l_partkey", "l_returnflag", "l_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 500")
def scan_sql_view(spark, sf_dir):
    tables.create_view(spark, "tessera_orders", _orders(spark, sf_dir))
    return spark.sql("SELECT o_custkey, o_orderkey FROM tessera_orders WHERE o_orderkey BETWEEN 10 AND 500")


@query("SELECT * FROM customer WHERE c_nationkey = 7")
def filter_eq_int(spark, sf_dir):
    return scan(spark, _table(spark, sf_dir, "customer", "c_nationkey"), P.eqt("c_nationkey", 7))


@query(f"SELECT {LINE} FROM lineitem WHERE l_orderkey = 1")
def filter_eq_long(spark, sf_dir):
    return scan(spark, _lineitem(spark, sf_dir), P.eqt("l_orderkey", 1), LINE.split(", "))


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_string(spark, sf_dir):
    return scan(spark, _table(spark, sf_dir, "customer", "c_mktsegment"), P.eqt("c_mktsegment", "BUILDING"))


@query("SELECT l_shipdate::DATE::VARCHAR AS l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate::DATE = DATE '1995-06-17'")
def filter_eq_date(spark, sf_dir):
    return scan(spark, _dated(spark, sf_dir), P.eqt("l_shipdate", datetime.date(1995, 6, 17)), ["l_shipdate", "l_orderkey", "l_linenumber"]).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def filter_range_timestamp(spark, sf_dir):
    zone = datetime.timezone.utc
    low, high = datetime.datetime(2024, 1, 2, tzinfo=zone), datetime.datetime(2024, 1, 20, 12, tzinfo=zone)
    return scan(spark, _events(spark, sf_dir), P.between("ts", low, high), ["event_id", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, date_trunc('day', ts) AS ts FROM events WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-15 00:00:00'")
def filter_eq_timestamp(spark, sf_dir):
    return scan(spark, _days(spark, sf_dir), P.eqt("ts", datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc)), ["event_id", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT doc_id, toxic = 1 AS toxic FROM labels WHERE toxic = 1")
def filter_eq_bool(spark, sf_dir):
    path = _table(spark, sf_dir, "labels", "toxic", lambda df: df.select("doc_id", (F.col("toxic") == 1).alias("toxic")), "boolean")
    return scan(spark, path, P.eqt("toxic", True), ["doc_id", "toxic"])


@query("SELECT l_orderkey, l_linenumber::SMALLINT AS l_linenumber FROM lineitem WHERE l_linenumber = 3")
def filter_eq_short(spark, sf_dir):
    path = _table(spark, sf_dir, "lineitem", "l_linenumber", lambda df: df.withColumn("l_linenumber", F.col("l_linenumber").cast("short")), "short")
    return scan(spark, path, P.eqt("l_linenumber", 3), ["l_orderkey", "l_linenumber"])


@query("SELECT n_name, n_regionkey::TINYINT AS n_regionkey FROM nation WHERE n_regionkey = 2")
def filter_eq_byte(spark, sf_dir):
    path = _table(spark, sf_dir, "nation", "n_regionkey", lambda df: df.withColumn("n_regionkey", F.col("n_regionkey").cast("byte")), "byte")
    return scan(spark, path, P.eqt("n_regionkey", 2), ["n_name", "n_regionkey"])


def _range(name: str, sign: str, build) -> None:
    def run(spark, sf_dir):
        return scan(spark, _lineitem(spark, sf_dir, "l_partkey"), build("l_partkey", 50), LINE.split(", "))

    run.__name__ = name
    query(f"SELECT {LINE} FROM lineitem WHERE l_partkey {sign} 50")(run)


for _name, _sign, _build in (("filter_gt", ">", P.gt), ("filter_ge", ">=", P.ge), ("filter_lt", "<", P.lt), ("filter_le", "<=", P.le)):
    _range(_name, _sign, _build)


@query("SELECT * FROM part WHERE p_size IN (1, 7, 49, 1000)")
def filter_in(spark, sf_dir):
    return scan(spark, _part(spark, sf_dir), P.in_("p_size", 1, 7, 49, 1000, 7))


@query("SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, sf_dir):
    return scan(spark, _part(spark, sf_dir), P.between("p_size", 10, 20))


NULLED = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders WHERE "


@query(NULLED + "nullif(o_orderstatus, 'P') IS NULL")
def filter_isnull(spark, sf_dir):
    return scan(spark, _with_nulls(spark, sf_dir), P.nvl("o_orderstatus"), ["o_orderkey", "o_orderstatus"])


@query(NULLED + "nullif(o_orderstatus, 'P') IS NOT NULL")
def filter_notnull(spark, sf_dir):
    return scan(spark, _with_nulls(spark, sf_dir), P.not_null("o_orderstatus"), ["o_orderkey", "o_orderstatus"])


@query(NULLED + "nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM 'F'")
def filter_nullsafe(spark, sf_dir):
    return scan(spark, _with_nulls(spark, sf_dir), P.null_safe("o_orderstatus", "F"), ["o_orderkey", "o_orderstatus"])


@query(NULLED + "nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'")
def filter_not_nullsafe(spark, sf_dir):
    return scan(spark, _with_nulls(spark, sf_dir), ~P.null_safe("o_orderstatus", "F"), ["o_orderkey", "o_orderstatus"])


@query(NULLED + "nullif(o_orderstatus, 'P') = NULL")
def filter_eq_null(spark, sf_dir):
    df = tables.read_indexed(spark, _with_nulls(spark, sf_dir))
    return df.filter(F.col("o_orderstatus") == F.lit(None)).select("o_orderkey", "o_orderstatus")


@query(NULLED + "NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def two_valued_not(spark, sf_dir):
    return scan(spark, _with_nulls(spark, sf_dir), ~P.eqt("o_orderstatus", "F"), ["o_orderkey", "o_orderstatus"], two_valued=True)


@query(NULLED + "NOT (nullif(o_orderstatus, 'P') = 'F')")
def filter_not(spark, sf_dir):
    return scan(spark, _with_nulls(spark, sf_dir), ~P.eqt("o_orderstatus", "F"), ["o_orderkey", "o_orderstatus"])


@query("SELECT * FROM part WHERE p_brand <> 'Brand#11'")
def filter_ne(spark, sf_dir):
    df = tables.read_indexed(spark, _part(spark, sf_dir))
    return df.filter(F.col("p_brand") != "Brand#11")


def _like(name: str, pattern: str, negate: bool = False) -> None:
    def run(spark, sf_dir):
        found = F.col("p_name").like(pattern)
        return tables.read_indexed(spark, _part(spark, sf_dir)).filter(~found if negate else found)

    run.__name__ = name
    query(f"SELECT * FROM part WHERE p_name {'NOT ' * negate}LIKE '{pattern}'")(run)


_like("filter_like_prefix", "b%")
_like("filter_like_suffix", "%t")
_like("filter_like_contains", "%a%")
_like("filter_not_like", "s%", True)


@query(f"SELECT {LINE} FROM lineitem WHERE (l_orderkey < 100 AND l_quantity > 20) OR (l_partkey = 5 AND l_linenumber >= 2)")
def filter_and_or(spark, sf_dir):
    df = tables.read_indexed(spark, _lineitem(spark, sf_dir))
    index = (P.lt("l_orderkey", 100), P.and_(P.eqt("l_partkey", 5), P.ge("l_linenumber", 2)))
    first, second = (P.to_column(P.bind(x, df.schema)) for x in index)
    return df.filter((first & (F.col("l_quantity") > 20)) | second).select(*LINE.split(", "))


@query(f"SELECT {LINE} FROM lineitem WHERE NOT (l_orderkey < 14000 AND l_linenumber = 1)")
def filter_not_and_mixed(spark, sf_dir):
    return scan(spark, _lineitem(spark, sf_dir), ~(P.lt("l_orderkey", 14000) & P.eqt("l_linenumber", 1)), LINE.split(", "))


@query("SELECT * FROM nation WHERE false")
def filter_false(spark, sf_dir):
    return scan(spark, _table(spark, sf_dir, "nation", "n_nationkey"), P.FALSE & P.eqt("n_nationkey", 1))


@query("SELECT * FROM nation")
def filter_true(spark, sf_dir):
    return scan(spark, _table(spark, sf_dir, "nation", "n_nationkey"), P.TRUE | P.eqt("n_nationkey", 1))


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, sf_dir):
    return tables.read_indexed(spark, _lineitem(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def count_metadata(spark, sf_dir):
    return spark.createDataFrame([(tables.metadata_count(spark, _lineitem(spark, sf_dir)),)], "n long")


@query("SELECT count(*) AS n FROM lineitem")
def count_without_metadata(spark, sf_dir):
    return spark.createDataFrame([(tables.metadata_count(spark, _lineitem(spark, sf_dir), enabled=False),)], "n long")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 1000")
def count_metadata_empty_partitions(spark, sf_dir):
    path = _lineitem(spark, sf_dir, shape=lambda df: df.filter("l_quantity > 1000"), kind="none", partition_by=("l_returnflag",))
    return spark.createDataFrame([(tables.metadata_count(spark, path),)], "n long")


@query(f"SELECT {LINE} FROM lineitem WHERE l_orderkey BETWEEN 10 AND 500")
def scan_without_pushdown(spark, sf_dir):
    return scan(spark, _lineitem(spark, sf_dir), P.between("l_orderkey", 10, 500), LINE.split(", "), pushdown=False)


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey > 500")
def count_filter(spark, sf_dir):
    return scan(spark, _lineitem(spark, sf_dir), P.gt("l_orderkey", 500)).agg(F.count("*").alias("n"))


@query(f"SELECT {ORDERS} FROM orders")
def partitioned_scan(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, partition_by=("o_orderstatus",)))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 300")
def partition_prune(spark, sf_dir):
    path = _orders(spark, sf_dir, partition_by=("o_orderstatus",))
    return scan(spark, path, P.eqt("o_orderstatus", "F") & P.lt("o_custkey", 300), ["o_custkey", "o_orderkey"])


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer")
def bucketed_scan(spark, sf_dir):
    name = "tessera_customer_buckets"
    tables.save_bucketed(spark.read.parquet(f"{sf_dir}/customer.parquet"), name, 4, "c_custkey", index="c_custkey", path=scratch.folder(spark, "buckets"))
    return spark.table(name).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 40")
def bucketed_index_scan(spark, sf_dir):
    path = tables.save_bucketed(spark.read.parquet(f"{sf_dir}/customer.parquet"), "tessera_indexed_buckets", 4, "c_custkey", index="c_custkey", path=scratch.folder(spark, "buckets"))
    return scan(spark, path, P.lt("c_custkey", 40), ["c_custkey", "c_name"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey <= 25")
def single_file(spark, sf_dir):
    path = f"{scratch.folder(spark, 'file')}/part.gz"
    files.write_file(spark.read.parquet(f"{sf_dir}/part.parquet"), path, index="p_partkey", strict_types=False)
    return files.read_file(spark, path, P.le("p_partkey", 25)).select("p_partkey", "p_name")


@query("SELECT count(*) AS rows FROM orders")
def single_file_info(spark, sf_dir):
    path = f"{scratch.folder(spark, 'file')}/orders.snappy"
    files.write_file(spark.read.parquet(f"{sf_dir}/orders.parquet"), path, index="o_custkey", strict_types=False, stripe_rows=100)
    return spark.createDataFrame([(files.file_info(spark, path).rows,)], "rows long")


def _codec(codec: str) -> None:
    def run(spark, sf_dir):
        return scan(spark, _part(spark, sf_dir, compression=codec))

    run.__name__ = f"codec_{codec}"
    query("SELECT * FROM part")(run)


for _name in ("none", "gzip", "snappy", "deflate"):
    _codec(_name)


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def stripe_small(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, stripe_rows=12)).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


_STATS = ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")


def _bounds(table: str, *columns: tuple[str, str]) -> str:
    """SQL for the bounds of (name, expression) of a table's columns, as text."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({x})::VARCHAR AS low, max({x})::VARCHAR AS high, bool_or({x} IS NULL) AS has_nulls FROM {table}" for c, x in columns)


@query(_bounds("lineitem", *((c, c) for c in _STATS)))
def stats_by_file(spark, sf_dir):
    found = inspect.file_stats(spark, _lineitem(spark, sf_dir), list(_STATS))
    number = F.col("column") != "l_returnflag"
    low = F.when(number, F.min(F.expr("try_cast(low AS bigint)")).cast("string")).otherwise(F.min("low"))
    high = F.when(number, F.max(F.expr("try_cast(high AS bigint)")).cast("string")).otherwise(F.max("high"))
    return found.groupBy("column").agg(low.alias("low"), high.alias("high"), F.max("has_nulls").alias("has_nulls"))


@query(_bounds("lineitem", ("l_shipdate", "l_shipdate::DATE"), ("late", "(l_shipdate >= DATE '1995-01-01')"), ("l_linenumber", "nullif(l_linenumber, 3)::TINYINT")))
def stats_of_dates_booleans_and_bytes(spark, sf_dir):
    shape = lambda df: df.select(F.col("l_shipdate").cast("date").alias("l_shipdate"), (F.col("l_shipdate") >= F.lit("1995-01-01")).alias("late"), F.nullif("l_linenumber", F.lit(3)).cast("byte").alias("l_linenumber"))
    path = _table(spark, sf_dir, "lineitem", "l_shipdate,late,l_linenumber", shape, "typed")
    return inspect.table_stats(spark, path).drop("known")


@query(_bounds("events", ("ts", "date_trunc('second', ts)")))
def stats_of_times(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = _table(spark, sf_dir, "events", "ts", lambda df: df.select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts")), "seconds")
    return inspect.table_stats(spark, path).drop("known")


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey = 1")
def surviving_stripes(spark, sf_dir):
    """All that a predicate finds lies in the stripes that footers and bloom filters leave."""
    path = _lineitem(spark, sf_dir, stripe_rows=1000)
    kept = inspect.surviving_stripes(spark, path, P.eqt("l_orderkey", 1)).select("file").distinct()
    rows = tables.read_indexed(spark, path).select("l_orderkey", F.input_file_name().alias("file"))
    return rows.join(kept, "file", "left_semi").filter("l_orderkey = 1").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows FROM lineitem")
def stripe_counts(spark, sf_dir):
    found = inspect.stripes(spark, _lineitem(spark, sf_dir, stripe_rows=1000)).filter("column = 'l_orderkey'")
    return found.agg(F.sum("rows").alias("rows"))


@query("SELECT o_orderpriority, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def compose_join(spark, sf_dir):
    orders, lines = tables.read_indexed(spark, _orders(spark, sf_dir)), tables.read_indexed(spark, _lineitem(spark, sf_dir))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def _join(how: str, sql: str) -> None:
    def run(spark, sf_dir):
        lines = scan(spark, _lineitem(spark, sf_dir), P.lt("l_partkey", 40), ["l_orderkey", "l_linenumber"])
        orders = scan(spark, _orders(spark, sf_dir), columns=["o_orderkey", "o_orderpriority"])
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), how)

    run.__name__ = f"compose_{how}_join"
    query(sql)(run)


_FEW = "(SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < 40)"
_join("left", f"SELECT o_orderkey, o_orderpriority, l_orderkey, l_linenumber FROM orders LEFT JOIN {_FEW} l ON o_orderkey = l_orderkey")
_join("right", f"SELECT o_orderkey, o_orderpriority, l_orderkey, l_linenumber FROM orders RIGHT JOIN {_FEW} l ON o_orderkey = l_orderkey")
_join("full", f"SELECT o_orderkey, o_orderpriority, l_orderkey, l_linenumber FROM orders FULL JOIN {_FEW} l ON o_orderkey = l_orderkey")
_join("left_semi", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {_FEW})")
_join("left_anti", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {_FEW})")


@query("SELECT c_mktsegment, sum(o_orderkey)::BIGINT AS keys, count(DISTINCT o_custkey) AS customers FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 7 GROUP BY 1")
def compose_broadcast_join(spark, sf_dir):
    few = scan(spark, _table(spark, sf_dir, "customer", "c_nationkey"), P.eqt("c_nationkey", 7), ["c_custkey", "c_mktsegment"])
    orders = scan(spark, _orders(spark, sf_dir), columns=["o_custkey", "o_orderkey"])
    return few.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.sum("o_orderkey").alias("keys"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus)::TINYINT AS every FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def compose_rollup(spark, sf_dir):
    return tables.read_indexed(spark, _lineitem(spark, sf_dir)).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_linestatus").alias("every"))


@query("SELECT p_brand, p_size, count(*) AS n, max(p_name) AS last FROM part GROUP BY CUBE (p_brand, p_size)")
def compose_cube(spark, sf_dir):
    return tables.read_indexed(spark, _part(spark, sf_dir)).cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.max("p_name").alias("last"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(l_linenumber) FILTER (WHERE l_quantity > 25)::BIGINT AS lines, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY 1 HAVING count(*) > 3")
def compose_distinct_agg(spark, sf_dir):
    lines = F.sum(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("lines")
    found = tables.read_indexed(spark, _lineitem(spark, sf_dir)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), lines, F.count_distinct("l_linenumber").alias("numbers"))
    return found.filter("n > 3").drop("n")


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def compose_intersect(spark, sf_dir):
    customers = scan(spark, _table(spark, sf_dir, "customer", "c_nationkey"), P.lt("c_nationkey", 10), ["c_custkey"])
    return scan(spark, _orders(spark, sf_dir), columns=["o_custkey"]).toDF("key").intersect(customers)


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def compose_except(spark, sf_dir):
    served = tables.read_indexed(spark, _orders(spark, sf_dir)).filter("o_orderstatus = 'F'").select("o_custkey")
    return scan(spark, _table(spark, sf_dir, "customer", "c_nationkey"), columns=["c_custkey"]).toDF("key").subtract(served)


@query(
    "SELECT event_id, upper(event_type) AS kind, json_extract_string(props, '$.k')::INTEGER AS k, date_trunc('hour', ts) AS hour, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level, "
    "coalesce(nullif(event_type, 'view'), '-') AS other, length(event_type)::INTEGER AS n, (floor(value) % 7)::BIGINT AS rest FROM events"
)
def compose_scalars(spark, sf_dir):
    df = tables.read_indexed(spark, _events(spark, sf_dir))
    return df.select(
        "event_id", F.upper("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("level"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("-")).alias("other"), F.length("event_type").alias("n"), (F.floor("value") % 7).alias("rest"),
    )


@query("SELECT p_partkey, length(p_name) - length(replace(p_name, 'e', '')) AS e FROM part")
def compose_pandas_udf(spark, sf_dir):
    import pandas as pd

    def letters(names):
        return names.str.count("e")

    letters.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return tables.read_indexed(spark, _part(spark, sf_dir)).select("p_partkey", F.pandas_udf(letters, "long")("p_name").alias("e"))


@query("SELECT l_returnflag, (max(l_orderkey) - min(l_orderkey))::BIGINT AS span FROM lineitem GROUP BY 1")
def compose_pandas_aggregate(spark, sf_dir):
    import pandas as pd

    def span(keys):
        return int(keys.max() - keys.min())

    span.__annotations__ = {"keys": pd.Series, "return": int}
    # Few rows a group: each line's order is one of those of its flag and number.
    lines = tables.read_indexed(spark, _lineitem(spark, sf_dir)).groupBy("l_returnflag", "l_linenumber").agg(F.max("l_orderkey").alias("high"), F.min("l_orderkey").alias("low"))
    ends = lines.select("l_returnflag", F.explode(F.array("low", "high")).alias("key"))
    return ends.groupBy("l_returnflag").agg(F.pandas_udf(span, "long")("key").alias("span"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def compose_table_function(spark, sf_dir):
    class Words:
        def eval(self, name):
            for word in name.split(" "):
                yield (word,)

    spark.udtf.register("tessera_words", F.udtf(Words, returnType="word string"))
    tables.create_view(spark, "tessera_part", _part(spark, sf_dir))
    return spark.sql("SELECT p_partkey, word FROM tessera_part, LATERAL tessera_words(p_name)")


@query("SELECT o_custkey, o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS run, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
def compose_window_frame(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return tables.read_indexed(spark, _orders(spark, sf_dir)).select("o_custkey", "o_orderkey", F.sum("o_orderkey").over(order.rowsBetween(-2, 0)).alias("run"), F.lag("o_orderkey").over(order).alias("before"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most, min(l_tax) AS least FROM lineitem GROUP BY 1, 2")
def compose_agg(spark, sf_dir):
    return tables.read_indexed(spark, _lineitem(spark, sf_dir)).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"), F.min("l_tax").alias("least"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS nth FROM orders")
def compose_window(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return tables.read_indexed(spark, _orders(spark, sf_dir)).select("o_custkey", "o_orderkey", F.row_number().over(order).alias("nth"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def compose_topk(spark, sf_dir):
    return tables.read_indexed(spark, _orders(spark, sf_dir)).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def compose_union(spark, sf_dir):
    customers = scan(spark, _table(spark, sf_dir, "customer", "c_nationkey"), columns=["c_custkey"])
    return scan(spark, _orders(spark, sf_dir), columns=["o_custkey"]).toDF("key").union(customers).distinct()


def _streamed(spark, frame, mode: str):
    """A streaming query over what there is, run to its end into a table in memory."""
    name = f"tessera_stream_{next(_numbers)}"
    running = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def compose_stream(spark, sf_dir):
    return _streamed(spark, read_stream(spark, _lineitem(spark, sf_dir)).groupBy("l_returnflag").agg(F.count("*").alias("n")), "complete")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def compose_windowed_stream(spark, sf_dir):
    """Counts by day and type under a watermark; a late row is one that comes more than a month behind."""
    found = windowed_counts(read_stream(spark, _events(spark, sf_dir), max_files=1), "ts", "1 day", "40 days", "event_type")
    return _streamed(spark, found, "complete").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


_numbers = itertools.count()
