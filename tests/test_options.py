import pytest
from pyspark.sql import types as T

from tessera.sources import options, schema


def test_index_columns():
    assert options.index_columns(None) == options.index_columns("") == options.index_columns(" , ,") == []
    assert options.index_columns("col1, col2 ,,col3") == ["col1", "col2", "col3"]
    with pytest.raises(ValueError):
        options.index_columns("a,b,a")


def test_codec():
    assert [options.codec(x) for x in ("NONE", "Deflate", "gzip", "SNAPPY")] == ["none", "deflate", "gzip", "snappy"]
    assert [options.codec(None, x) for x in ("a.gz", "a.deflate", "a.snappy", "a.txt", "a")] == ["gzip", "deflate", "snappy", "none", "none"]
    with pytest.raises(ValueError, match="Unknown codec: lzo"):
        options.codec("lzo")


def test_sizes():
    assert options.stripe_rows(1) == 1
    with pytest.raises(ValueError):
        options.stripe_rows(0)
    assert [options.buffer_size(n) for n in (1, 4096, 5000, 300_000, 10**9)] == [4096, 4096, 8192, 524288, 524288]
    assert [options.file_buffer_size(n) for n in (None, 4096, 256 << 10, (256 << 10) + 1, 1 << 20)] == [256 << 10] * 4 + [1 << 20]


def test_properties():
    assert options.properties({"a": "", "": "b"}) == {"a": "", "": "b"}
    for bad in ({"a": None}, {None: "a"}):
        with pytest.raises(ValueError):
            options.properties(bad)


@pytest.mark.parametrize("kind", ["float", "double", "void", "binary", "decimal(10,2)", "array<int>", "timestamp_ntz"])
def test_types_that_are_not_supported(spark, kind):
    s = T.StructType().add("a", T.IntegerType()).add("b", T._parse_datatype_string(kind) if kind != "void" else T.NullType())
    with pytest.raises(ValueError, match="Column b of type"):
        schema.check(s, [], [])
    schema.check(s, ["a"], [], strict=False)
    with pytest.raises(ValueError):
        schema.check(s, ["b"], [], strict=False)


def test_order_of_columns(spark):
    s = T._parse_datatype_string("c1 int, c2 long, c3 string, c4 string, p int")
    got = schema.ordered(s, ["c4", "c2"], ["p"])
    assert got.names == ["c4", "c2", "c1", "c3", "p"] and schema.index_of(got) == ["c4", "c2"]
    with pytest.raises(ValueError, match="no data column p"):
        schema.check(s, ["p"], ["p"])
    with pytest.raises(ValueError):
        schema.check(T.StructType().add("p", T.IntegerType()), [], ["p"])
