"""Times the benchmark shapes over indexed tables and the same shapes over plain Parquet.

Prints one JSON line. ``value`` is the sum of the medians of the indexed shapes; ``plain`` holds the same
shapes over Parquet without index, and ``rows_scanned`` what the scans put out after skipping.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.sources import inspect, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def timed(f, runs: int = RUNS) -> float:
    f()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return round(median(took), 4)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    home = tempfile.mkdtemp(prefix="bench-")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").withColumn("l_key", F.format_string("key%08d", "l_orderkey"))
    lines = lines.repartitionByRange(8, "l_orderkey").sortWithinPartitions("l_orderkey").cache()
    lines.count()
    index = "l_orderkey,l_partkey,l_key"
    tables.write_indexed(lines, f"{home}/indexed", index=index, strict_types=False)
    lines.write.option("compression", "gzip").parquet(f"{home}/plain")
    sides = {"indexed": lambda: tables.read_indexed(spark, f"{home}/indexed"), "plain": lambda: spark.read.parquet(f"{home}/plain")}
    shapes = {
        "scan_all": lambda df: df,
        "string_range_all": lambda df: df.filter("l_key BETWEEN 'key00003000' AND 'key00004000'"),
        "string_range_2": lambda df: df.filter("l_key BETWEEN 'key00003000' AND 'key00004000'").select("l_linenumber", "l_quantity"),
        "int_range_2": lambda df: df.filter("l_orderkey BETWEEN 40 AND 12000").select("l_linenumber", "l_quantity"),
        "int_point": lambda df: df.filter("l_orderkey = 4321"),
        "string_point": lambda df: df.filter("l_key = 'key00004321'"),
        "hashed_point": lambda df: df.filter("l_partkey = 777"),
        "project_1": lambda df: df.select("l_quantity"),
        "project_3": lambda df: df.select("l_quantity", "l_orderkey", "l_key"),
        "project_6": lambda df: df.select("l_quantity", "l_orderkey", "l_key", "l_tax", "l_discount", "l_returnflag"),
        "count_filter": lambda df: df.filter("l_orderkey > 700").agg(F.count("*")),
    }
    took = {side: {name: timed(lambda: drain(shape(read()))) for name, shape in shapes.items()} for side, read in sides.items()}
    # Four times the rows, under distinct keys and in no order: only bloom filters can skip.
    many = lines.withColumn("l_copy", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("l_row", F.xxhash64("l_orderkey", "l_linenumber", "l_copy")).repartition(8, "l_row")
    tables.write_indexed(many, f"{home}/many-indexed", index="l_row", strict_types=False)
    many.write.option("compression", "gzip").parquet(f"{home}/many-plain")
    key = many.agg(F.min_by("l_row", F.abs("l_row"))).first()[0]
    point = lambda df: df.filter(F.col("l_row") == key)
    repeated = {"indexed": lambda: tables.read_indexed(spark, f"{home}/many-indexed"), "plain": lambda: spark.read.parquet(f"{home}/many-plain")}
    for side, read in repeated.items():
        took[side]["repeated_point"] = timed(lambda: drain(point(read())))
    for codec in ("none", "gzip", "deflate", "snappy"):
        took["indexed"][f"write_{codec}"] = timed(lambda: tables.write_indexed(lines, f"{home}/w", index=index, strict_types=False, compression=codec, mode="overwrite"), 3)
    for codec in ("none", "gzip", "snappy"):
        took["plain"][f"write_{codec}"] = timed(lambda: lines.write.mode("overwrite").option("compression", codec).parquet(f"{home}/w"), 3)
    took["indexed"]["metadata_count"] = timed(lambda: tables.metadata_count(spark, f"{home}/indexed"))
    points = ("string_range_all", "int_range_2", "int_point", "string_point", "hashed_point")
    scanned = {side: {name: inspect.rows_scanned(shapes[name](read())) for name in points} for side, read in sides.items()}
    for side, read in repeated.items():
        scanned[side]["repeated_point"] = inspect.rows_scanned(point(read()))
    total = round(sum(took["indexed"].values()), 3)
    print(json.dumps({"metric": "indexed_tables_total", "value": total, "unit": "sec", "queries": took["indexed"], "plain": took["plain"], "rows_scanned": scanned, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
