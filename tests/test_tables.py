"""Tables written, read back, filtered, counted and inspected."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import streaming
from tessera.functions import filters as P
from tessera.operators import planned, scan
from tessera.sources import bloom, files, inspect, sidecar, tables
from tessera.sources.tables import read_indexed, write_indexed

DAY = datetime.date(2021, 3, 1)
SENSORS = "station string, reading int, taken date, quality smallint, note string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


@pytest.fixture
def df(spark):
    """Seventeen readings of four stations, some without a note or a quality."""
    rows = [("nesw"[i % 4] + "-mast", 100 - 7 * i, DAY + datetime.timedelta(days=i // 3), None if i % 5 == 4 else i % 5, None if i % 6 == 0 else f"n{i * i}") for i in range(17)]
    return spark.createDataFrame(rows, SENSORS)


def same(a, b):
    assert sorted(map(repr, a.select(*map(P.quoted, sorted(a.columns))).collect())) == sorted(map(repr, b.select(*map(P.quoted, sorted(b.columns))).collect()))


# Writing and reading.


def test_index_columns_come_first(spark, df, path):
    write_indexed(df, path, index=" taken ,station")
    got = read_indexed(spark, path)
    assert got.columns == ["taken", "station", "reading", "quality", "note"] and tables.table_index(spark, path) == ["taken", "station"]
    same(got, df)


def test_partition_columns_come_last(spark, df, path):
    write_indexed(df, path, index="reading", partition_by="station,quality")
    got = read_indexed(spark, path)
    assert got.columns == ["reading", "taken", "note", "station", "quality"] and dict(got.dtypes)["quality"] == "smallint"
    same(got, df)
    same(scan(spark, path, P.eqt("station", "e-mast") & P.gt("reading", 0)), df.filter("station = 'e-mast' and reading > 0"))


def test_columns_that_are_not_there(df, path):
    for options in ({"index": "station", "partition_by": "station"}, {"index": "nothing"}, {"partition_by": "nothing"}):
        with pytest.raises(ValueError, match="station|nothing"):
            write_indexed(df, path, **options)


def test_any_name_can_be_a_column(spark, path):
    df = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(30)], "`a.b` int, `c``d` int, `e f` string")
    write_indexed(df, path, index=["a.b", "c`d"], stripe_rows=10)
    same(read_indexed(spark, path), df)
    same(scan(spark, path, P.gt("a.b", 20) & P.in_("c`d", 0, 2) & ~P.nvl("e f"), ["e f", "a.b"]), df.filter("`a.b` > 20 and `c``d` <> 1").select("`e f`", "`a.b`"))
    assert {r["column"] for r in inspect.table_stats(spark, path).collect()} == set(df.columns)
    assert [s for _, s in inspect.surviving(spark, path, P.gt("a.b", 20))] and {r["low"] for r in inspect.table_stats(spark, path, ["a.b"]).collect()} == {"0"}
    tables.create_view(spark, "odd names", path)
    assert spark.sql("SELECT count(*) FROM `odd names` WHERE `a.b` < 5").first()[0] == 5


def test_clustered_files_are_sorted(spark, df, path):
    write_indexed(df.coalesce(1), path, index="reading", cluster=True)
    got = [r["reading"] for r in read_indexed(spark, path).collect()]
    assert got == sorted(got) and len(got) == 17


def test_save_modes(spark, df, path):
    write_indexed(df, path, index="station")
    with pytest.raises(Exception):
        write_indexed(df, path, index="station")
    write_indexed(df, path, index="station", mode="append")
    write_indexed(df, path, index="station", mode="ignore")
    assert read_indexed(spark, path).count() == 34
    with pytest.raises(ValueError):
        write_indexed(df, path, index="reading", mode="append")
    with pytest.raises(ValueError, match="Unknown save mode"):
        write_indexed(df, path, mode="merge")
    write_indexed(df, path, index="reading", mode="overwrite")
    assert tables.table_index(spark, path) == ["reading"] and read_indexed(spark, path).count() == 17


def test_properties_and_metadata(spark, df, path):
    df = df.withMetadata("reading", {"unit": "hPa"})
    write_indexed(df, path, index="reading", properties={"": "", "owner": "met"})
    assert tables.table_properties(spark, path) == {"": "", "owner": "met"}
    assert tables.table_schema(spark, path)["reading"].metadata == {"unit": "hPa", "indexed": True}
    with pytest.raises(FileNotFoundError):
        tables.table_properties(spark, path + "-none")


def test_without_a_sidecar(spark, df, path):
    df.write.parquet(path)
    same(read_indexed(spark, path), df)
    same(scan(spark, path, P.lt("reading", 50)), df.filter("reading < 50"))


def test_files_with_another_order_of_columns_are_read_by_name(spark, df, path):
    write_indexed(df, path, index="taken")
    df.select("note", "taken", "quality", "station", "reading").write.mode("append").parquet(path)
    same(read_indexed(spark, path), df.union(df))


def test_partition_values_keep_their_type(spark, path):
    df = spark.createDataFrame([(1, "007"), (2, "8")], "a int, p string")
    write_indexed(df, path, partition_by="p")
    assert read_indexed(spark, path).schema["p"].dataType == T.StringType()
    same(read_indexed(spark, path), df)


@pytest.mark.parametrize("codec,found", [("none", "UNCOMPRESSED"), ("gzip", "GZIP"), ("deflate", "GZIP"), ("snappy", "SNAPPY")])
def test_codecs(spark, df, path, codec, found):
    write_indexed(df, path, index="station", compression=codec.upper(), file_buffer=1 << 20)
    same(read_indexed(spark, path), df)
    assert {r.codec for r in inspect.stripes(spark, path).collect()} == {found} and sidecar.read(spark, path)["codec"] == codec


TYPES = {
    "int": [-5, 12, None], "bigint": [1 << 40, -1, None], "string": ["é", "z", None], "date": [DAY, datetime.date(1969, 12, 30), None],
    "timestamp": [datetime.datetime(2019, 7, 9, 5), datetime.datetime(1965, 1, 1, 6, 0, 0, 123), None], "boolean": [False, True, None], "smallint": [300, -2, None], "tinyint": [-128, 7, None],
}


@pytest.mark.parametrize("kind", TYPES)
def test_all_types(spark, path, kind):
    df = spark.createDataFrame([(v,) for v in TYPES[kind]], f"v {kind}")
    write_indexed(df, path, index="v")
    got = read_indexed(spark, path)
    assert got.dtypes == df.dtypes
    same(got, df)
    for x in TYPES[kind][:2]:
        assert [r[0] for r in scan(spark, path, P.eqt("v", x)).collect()] == [x]
        assert {r[0] for r in scan(spark, path, ~P.null_safe("v", x)).collect()} == set(TYPES[kind]) - {x}
        assert len(inspect.surviving(spark, path, P.eqt("v", x))) > 0


def test_buckets_have_a_sidecar(spark, df, tmp_path):
    place = tables.save_bucketed(df, "readings_in_buckets", 3, "station", index="station", path=str(tmp_path / "b"), properties={"k": "v"}, strict_types=True)
    same(read_indexed(spark, place), df)
    same(spark.table("readings_in_buckets"), df)
    assert tables.table_index(spark, place) == ["station"] and tables.table_properties(spark, place) == {"k": "v"}
    assert tables.metadata_count(spark, place) == 17 and len(inspect.surviving(spark, place, P.eqt("station", "x-mast"))) == 0
    tables.save_bucketed(df, "readings_in_buckets", 3, "station", index="station", path=str(tmp_path / "b"), mode="append")
    assert spark.table("readings_in_buckets").count() == 34
    with pytest.raises(Exception):
        tables.save_bucketed(df, "readings_in_buckets", 3, "station", mode="error")
    with pytest.raises(ValueError):
        tables.save_bucketed(df.withColumn("x", F.lit(1.5)), "other_buckets", 3, "station", strict_types=True)
    joined = spark.table("readings_in_buckets").alias("a").hint("merge").join(spark.table("readings_in_buckets").alias("b"), "station")
    assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
    spark.sql("DROP TABLE readings_in_buckets")


# Filters.


@pytest.mark.parametrize(
    "test",
    ["reading = 72", "reading > 30 and quality <= 2", "taken >= date'2021-03-03' and taken < date'2021-03-05'", "station in ('n-mast', 'x', 'w-mast')", "reading = 73", "note like 'n1%' and not note like '%4'",
     "not (station = 'e-mast' and quality = 1)", "station <> 's-mast'", "quality <=> 3", "not (quality <=> 3)", "note is null", "quality is not null or reading < 0"],
)
def test_filters_match_those_of_the_source(spark, df, path, test):
    write_indexed(df, path, index="station,reading,taken", stripe_rows=3)
    same(read_indexed(spark, path).filter(test), df.filter(test))
    same(read_indexed(spark, path, pushdown=False).filter(test), df.filter(test))


def test_nulls(spark, df, path):
    write_indexed(df, path, index="quality,note")
    for c, x in (("quality", 2), ("note", "n4")):
        for tree, test in ((P.nvl(c), f"{c} is null"), (~P.nvl(c), f"{c} is not null"), (~P.eqt(c, x), f"not ({c} = '{x}')"), (P.null_safe(c, x), f"{c} <=> '{x}'"), (~P.null_safe(c, x), f"not ({c} <=> '{x}')"), (~P.null_safe(c, None), f"not ({c} <=> null)")):
            same(scan(spark, path, tree), df.filter(test))
            assert not two_valued_differs(spark, path, tree) or tree == ~P.eqt(c, x)


def two_valued_differs(spark, path, tree):
    return scan(spark, path, tree).count() != scan(spark, path, tree, two_valued=True).count()


def test_projection_in_any_order(spark, df, path):
    write_indexed(df, path, index="reading,station")
    for names in (["station", "reading", "note"], ["note"], ["quality", "reading"], df.columns[::-1]):
        got = scan(spark, path, columns=names)
        assert got.columns == names
        same(got, df.select(*names))


def test_constant_predicates_need_no_scan(spark, df, path):
    write_indexed(df, path, index="taken")
    empty = scan(spark, path, P.FALSE & P.eqt("reading", 1))
    assert empty.count() == 0 and "FileScan" not in empty._jdf.queryExecution().executedPlan().toString()
    whole = scan(spark, path, P.TRUE | P.eqt("reading", 1))
    assert whole.count() == 17 and "Filter (" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_scan_checks_names_and_types(spark, df, path):
    write_indexed(df, path, index="reading")
    with pytest.raises(KeyError):
        scan(spark, path, P.eqt("nope", 1))
    for bad in (P.eqt("reading", "x"), P.null_safe("reading", "x"), P.eqt("quality", 1 << 15)):
        with pytest.raises(ValueError):
            scan(spark, path, bad)


def test_plans(spark, df, path):
    write_indexed(df, path, index="reading,station")
    own, other = P.gt("reading", 40), P.eqt("quality", 1)
    for tree, part, only in ((own, own, True), (own & other, own, False), (own | other, P.TRUE, False), (~(own & other), P.TRUE, False), (~own, ~own, True)):
        found = planned(spark, path, tree)
        assert P.state(found.index_tree) is P.state(part) and P.columns(found.index_tree) == P.columns(part) and found.index_only == only and found.known is None
    assert planned(spark, path, P.TRUE | own).known is True


def test_two_valued_scans_hand_the_index_to_the_reader(spark, path):
    write_indexed(spark.range(8000).select("id", (F.col("id") % 7).alias("k")).coalesce(1), path, index="id", stripe_rows=1000)
    found = scan(spark, path, P.lt("id", 500) & P.eqt("k", 3), two_valued=True)
    assert found.count() == 71 and inspect.rows_scanned(found) <= 1000


def test_pushdown_can_be_off_for_a_frame(spark, path):
    write_indexed(spark.range(10_000).coalesce(1), path, index="id", stripe_rows=1000)
    off, on = read_indexed(spark, path, pushdown=False).filter("id = 7"), read_indexed(spark, path).filter("id = 7")
    assert off.count() == on.count() == 1
    assert inspect.rows_scanned(on) == 1000 and inspect.rows_scanned(off) == 10_000
    assert inspect.rows_scanned(scan(spark, path, P.eqt("id", 7), pushdown=False)) == 10_000
    with tables.pushdown(spark, False):
        assert inspect.rows_scanned(read_indexed(spark, path).filter("id = 7")) == 10_000
    assert spark.conf.get(tables.PUSHDOWN) == "true"


def test_view(spark, df, path):
    write_indexed(df, path, index="taken")
    tables.create_view(spark, "readings", path)
    assert spark.table("readings").columns[0] == "taken"
    assert spark.sql("SELECT station FROM readings WHERE reading = 93").collect()[0][0] == "e-mast"


# Counts, stripes and statistics.


@pytest.mark.parametrize("n,rows", [(0, 10), (7, 10), (250, 10), (253, 10_000)])
def test_counts(spark, path, n, rows):
    write_indexed(spark.range(n), path, index="id", stripe_rows=rows)
    assert read_indexed(spark, path).count() == tables.metadata_count(spark, path) == tables.metadata_count(spark, path, enabled=False) == n
    assert read_indexed(spark, path).filter("id >= 5").count() == max(0, n - 5)


def test_an_empty_partitioned_table(spark, df, path):
    write_indexed(df.limit(0), path, index="reading", partition_by="station")
    assert read_indexed(spark, path).columns == ["reading", "taken", "quality", "note", "station"]
    assert read_indexed(spark, path).count() == tables.metadata_count(spark, path) == 0
    assert inspect.surviving(spark, path, P.eqt("reading", 1)) == [] and inspect.table_stats(spark, path).count() == 0
    write_indexed(df, path, index="reading", partition_by="station", mode="append")
    assert tables.metadata_count(spark, path) == 17


def test_stripes_are_skipped_by_bloom_filters_and_bounds(spark, path):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).cast("long").alias("k"), "id").coalesce(1)
    write_indexed(df, path, index="k", stripe_rows=1000)
    assert read_indexed(spark, path).filter("k = 7919").count() == 1 and inspect.rows_scanned(read_indexed(spark, path).filter("k = 7919")) <= 5000
    assert inspect.rows_scanned(read_indexed(spark, path).filter("id < 1500")) <= 2000
    assert len(inspect.surviving(spark, path, P.eqt("k", 7919))) <= 5 and len(inspect.surviving(spark, path, P.eqt("k", 7919), sketches=False)) == 40
    write_indexed(df, path, index="k", stripe_rows=1000, column_filters=False, mode="overwrite")
    assert inspect.rows_scanned(read_indexed(spark, path).filter("k = 7919")) == 40_000
    assert len(inspect.surviving(spark, path, P.eqt("k", 7919))) == 40


def test_times_are_pruned(spark, path):
    df = spark.range(8000).select(F.timestamp_seconds("id").alias("t")).coalesce(1)
    write_indexed(df, path, index="t", stripe_rows=1000)
    assert inspect.rows_scanned(read_indexed(spark, path).filter("t < timestamp '1970-01-01 00:01:00'")) == 1000
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == "INT96"
    late = datetime.datetime(1970, 1, 1, 1, 30, tzinfo=datetime.timezone.utc)
    assert [s for _, s in inspect.surviving(spark, path, P.ge("t", late))] == [5, 6, 7] and [s for _, s in inspect.surviving(spark, path, P.eqt("t", late))] == [5]
    assert inspect.surviving(spark, path, P.eqt("t", late + datetime.timedelta(microseconds=1))) == []


def test_surviving_stripes(spark, path):
    write_indexed(spark.range(100).select("id", F.when(F.col("id") >= 50, F.lit("x" * 5000)).alias("long"), F.lit(None).cast("int").alias("none")).coalesce(1), path, index="id", stripe_rows=10)
    where = lambda tree: [s for _, s in inspect.surviving(spark, path, tree)]
    assert where(P.eqt("id", 35) | P.ge("id", 90)) == [3, 9] and where(P.nvl("id")) == [] and len(where(~P.eqt("id", 35))) == 10
    assert where(P.in_("id", 5, 1000, 64)) == [0, 6] and where(P.null_safe("id", 77)) == [7] and len(where(~P.null_safe("id", 77))) == 10
    assert where(P.eqt("none", 1)) == [] and len(where(P.nvl("none"))) == 10
    # Bounds of very long texts are not in footers: those stripes may hold anything, the others hold nulls only.
    assert where(P.eqt("long", "y")) in ([], [5, 6, 7, 8, 9]) and where(P.eqt("long", "x" * 5000)) == [5, 6, 7, 8, 9]


def test_no_stripe_with_a_match_is_lost(spark, path):
    r = random.Random(4)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *"abcdefgh"]), r.choice([None, DAY, DAY + datetime.timedelta(days=r.randrange(9))])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a smallint, s string, d date").coalesce(1)
    write_indexed(df, path, index="a,s,d", stripe_rows=5)
    for _ in range(25):
        leaf = lambda: r.choice([P.eqt("a", r.randrange(42)), P.in_("s", *r.sample("abcxyz", 2)), P.null_safe("d", DAY + datetime.timedelta(days=r.randrange(10))), P.nvl("s"), P.gt("a", 35)])
        tree = r.choice([leaf(), leaf() & leaf(), leaf() | leaf(), ~leaf() & leaf()])
        kept = {s for _, s in inspect.surviving(spark, path, tree)}
        bound = P.bind(tree, df.schema)
        for k in range(60):
            part = rows[5 * k : 5 * k + 5]
            if k not in kept:
                assert spark.createDataFrame(part, df.schema).filter(P.to_column(bound, two_valued=True)).count() == 0


def test_bloom_filters_hold_what_was_written(spark, path, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(3000).select((F.col("id") * 3).cast("int").alias("i"), F.format_string("k%d", F.col("id") * 3).alias("s")).coalesce(1)
    write_indexed(df, path, index="i,s")
    (file,) = (tmp_path / "table").glob("*.parquet")
    data = file.read_bytes()
    places = bloom.places(data[-8 - int.from_bytes(data[-8:-4], "little") : -8])
    assert len(places) == pq.ParquetFile(file).metadata.num_row_groups == 1 and set(places[0]) == {"i", "s"}
    number, text = (bloom.test(lambda a, n: data[a : a + n], places[0][c], k) for c, k in (("i", "int"), ("s", "string")))
    assert all(number(3 * k) and text(f"k{3 * k}") for k in range(3000))
    assert sum(number(3 * k + 1) for k in range(3000)) < 300 and sum(text(f"k{3 * k + 1}") for k in range(3000)) < 300


def test_statistics_come_from_footers(spark, path):
    df = spark.range(500).select((F.col("id") - 9).alias("n"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id"))).alias("s"), (F.col("id") > 600).alias("b"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"), F.timestamp_seconds(F.col("id")).alias("t"))
    write_indexed(df.repartition(3), path, index="n", stripe_rows=50)
    got = {r["column"]: (r["low"], r["high"], r["has_nulls"]) for r in inspect.table_stats(spark, path).collect()}
    assert got == {"n": ("-9", "490", False), "s": ("t0", "t98", True), "b": ("false", "false", False), "d": ("2021-03-01", "2022-07-13", False), "t": ("1970-01-01 00:00:00", "1970-01-01 00:08:19", False)}
    each = inspect.file_stats(spark, path, ["n"])
    assert each.count() == 3 and "FileScan" not in each._jdf.queryExecution().executedPlan().toString()
    want = {r["f"]: (str(r["a"]), str(r["z"])) for r in read_indexed(spark, path).groupBy(F.input_file_name().alias("f")).agg(F.min("n").alias("a"), F.max("n").alias("z")).collect()}
    assert {r["file"]: (r["low"], r["high"]) for r in each.collect()} == want


# Single files and streams.


@pytest.mark.parametrize("end,codec", [(".gz", "GZIP"), (".deflate", "GZIP"), (".snappy", "SNAPPY"), (".any", "UNCOMPRESSED")])
def test_single_files(spark, df, tmp_path, end, codec):
    path = str(tmp_path / f"one{end}")
    files.write_file(df.repartition(4), path, index="reading", stripe_rows=5)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [f"one{end}"]
    same(files.read_file(spark, path), df)
    same(files.read_file(spark, path, P.ge("reading", 50) & ~P.nvl("note")), df.filter("reading >= 50 and note is not null"))
    assert files.read_file(spark, path, P.FALSE & P.nvl("note")).count() == 0 and files.read_file(spark, path, P.TRUE).count() == 17
    info = files.file_info(spark, path)
    assert (info.rows, info.codecs, info.schema.names[0], [s.rows for s in info.stripes]) == (17, (codec,), "reading", [5, 5, 5, 2])
    assert all(s.columns["reading"][2] is False for s in info.stripes) and files.file_info(spark, path, stripes=False).stripes == ()
    with pytest.raises(FileExistsError):
        files.write_file(df, path)


def test_an_empty_file(spark, df, tmp_path):
    files.write_file(df.limit(0), str(tmp_path / "none"))
    assert files.read_file(spark, str(tmp_path / "none")).count() == 0 and files.file_info(spark, str(tmp_path / "none")).rows == 0


def test_stream(spark, df, path):
    write_indexed(df, path, index="reading")
    run = streaming.read_stream(spark, path).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    run.awaitTermination()
    same(spark.table("streamed"), df)


def test_late_rows_of_a_stream(spark, path):
    """Files read one at a time: the third holds a row behind the watermark that the first set, which is not counted."""
    at = lambda h: datetime.datetime(2022, 5, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=h)
    for hours in ([30, 31], [40], [1, 41], [70]):
        write_indexed(spark.createDataFrame([(at(h), "k") for h in hours], "t timestamp, `k.k` string").coalesce(1), path, index="t", mode="append")
    found = streaming.windowed_counts(streaming.read_stream(spark, path, max_files=1), "t", "1 day", "2 hours", "k.k")
    run = found.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["start"].day, r["n"]) for r in spark.table("late").collect()] == [(2, 4)] and found.columns == ["start", "k.k", "n"]
