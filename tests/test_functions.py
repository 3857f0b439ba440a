from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tilework import functions as fn


def one(spark, column, *values, schema="x double"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_halves_round_up(spark):
    assert one(spark, fn.js_round("x"), -1.5, -0.5, 0.5, 1.5, 2.5, float("nan")) == [-1, 0, 1, 2, 3, None]


def test_quantize_holds_to_32_bits(spark):
    assert one(spark, fn.quantize("x", 1), 3e9, -3e9, -1.5) == [2147483647, -2147483648, -1]


def test_sigmoid_is_stable(spark):
    got = one(spark, fn.sigmoid("x"), 0.0, 800.0, -800.0, float("nan"), float("inf"))
    assert got == [0.5, 1.0, 0.0, 0.5, 0.5]


@pytest.mark.parametrize("text, label", [("1.0", "1"), ("1", "1"), ("-0", "0"), ("-0.50", "-0.5"), ("1e3", "1000"), (" 7 ", "7"), ("12abc", "12abc"), ("1d", "1d"), ("", ""), (None, ""), ("NaN", "NaN"), ("0.1", "0.1"), ("1e999", "1e999")])
def test_labels(spark, text, label):
    assert one(spark, fn.canon_label("x"), text, schema="x string") == [label]


def test_binary_words(spark):
    assert one(spark, fn.parse_binary01("x"), "TRUE", "n", "1.00", "2", "", None, "0e5", schema="x string") == [1, 0, 1, None, None, None, 0]


def test_strict_numbers(spark):
    assert one(spark, fn.to_number("x"), "1e3", ".5", "5.", "1d", "inf", "NaN", "0x1", "1e999", schema="x string") == [1000.0, 0.5, 5.0] + [None] * 5


def test_argmax_takes_the_first_of_equals(spark):
    assert one(spark, fn.argmax("x"), [1.0, 3.0, 3.0], [0.0, 0.0], schema="x array<double>") == [1, 0]


def test_linear_bin_edges(spark):
    got = one(spark, fn.linear_bin("x", 0.0, 32.0, 32), *[float(v) for v in range(33)], -1.0, 99.0)
    assert got == [*range(32), 31, 0, 31]


def test_i32_bytes_round_trip(spark):
    df = spark.createDataFrame([([1, -2, 2147483647, -2147483648],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(fn.unpack_i32_le(fn.pack_i32_le("x"))).collect()] == [[1, -2, 2147483647, -2147483648], []]


def test_amounts(spark):
    r = spark.range(1).select(fn.wei_to_unit(F.lit("1500000000000000000").cast("decimal(38,0)")), fn.unit_to_wei(F.lit("1.5").cast("decimal(20,18)"))).first()
    assert r[0] == Decimal("1.5") and r[1] == 1500000000000000000


def test_sizes_are_clamped():
    assert fn.clamp_for_size(3, 0) == (10, 1)
    trees, depth = fn.clamp_for_size(5000, 12)
    assert fn.bytes_of(trees, depth) <= fn.SIZE_LIMIT and (5000 - trees) % 25 == 0
    assert fn.clamp_for_size(65535, 2, "multiclass_classification", 70)[0] <= 65535 // 70


def test_bytes_of_integers(spark):
    """Little-endian bytes as struct packs them, a rest and null, and no step named more than once."""
    import struct

    values = [0, 1, -1, 255, -256, 65536, 0x01020304, -0x01020304, 2147483647, -2147483648]
    df = spark.createDataFrame([(values, bytearray(struct.pack("<10i", *values) + b"xyz")), ([], bytearray(b"abc")), (None, None)], "v array<long>, data binary")
    got = df.select(fn.pack_i32_le("v").alias("packed"), fn.unpack_i32_le("data").alias("back")).collect()
    assert bytes(got[0]["packed"]) == struct.pack("<10i", *values) and got[0]["back"] == values
    assert bytes(got[1]["packed"]) == b"" and got[1]["back"] == [] and got[2]["back"] == []
    plan = df.select(fn.unpack_i32_le(fn.pack_i32_le("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 1


def test_labels_that_are_no_numbers_are_not_formatted(spark):
    got = one(spark, fn.canon_label("x"), " Yes", "no", "1.0", "2.50", "1e20", "", None, "NaN", "null", schema="x string")
    assert got == ["Yes", "no", "1", "2.5", "1.0E20", "", "", "NaN", "null"]
    plan = spark.createDataFrame([("a",)], "x string").select(fn.canon_label("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("isnull(lambda") < plan.index("format_string")
