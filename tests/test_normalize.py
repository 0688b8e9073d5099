from pyspark.sql import functions as F

from stockflow.functions import normalize as N


def _eval(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_tier(spark):
    got = _eval(spark, [" TIER1 ", "tier2", "Tier3", "gold", "", None], N.tier)
    assert got == ["tier1", "tier2", "tier3", "tier3", "tier3", "tier3"]


def test_flag(spark):
    vals = ["1", " yes ", "TRUE", "y", "no", "0", "", None, " "]
    assert _eval(spark, vals, lambda c: N.flag(c, False)) == [1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert _eval(spark, vals, lambda c: N.flag(c, True)) == [1, 1, 1, 1, 0, 0, 1, 1, 0]


def test_nullable_int(spark):
    vals = ["100", " 12 ", "12.7", "-3.9", "1e3", "0x10", "abc", "", None, " ", "1d"]
    assert _eval(spark, vals, N.nullable_int) == [100, 12, 12, -3, 1000, 16, None, None, None, 0, None]


def test_quantity(spark):
    df = spark.createDataFrame([(v,) for v in ["5", "0", "-2", "2.5", "abc", None, ""]], "x string")
    q, ok = N.quantity(F.col("x"))
    got = [(r[0], r[1]) for r in df.select(q, ok).collect()]
    assert got == [(5, True), (0, True), (-2, True), (None, False), (None, False), (0, True), (0, True)]


def test_first_truthy(spark):
    df = spark.createDataFrame([("0", "", "7"), (None, "5", "9"), ("3", "4", "5")], "a string, b string, c string")
    got = [r[0] for r in df.select(N.first_truthy("a", "b", "c")).collect()]
    assert got == ["7", "5", "3"]


def test_import_rows_absent_flag_columns(spark):
    raw = spark.createDataFrame([("A", "tier1", "5"), ("B", "tier2", "")],
                                "internal_sku string, tier string, available_units string")
    rows = {r.internal_sku: r for r in N.import_rows(raw).collect()}
    assert rows["A"].sync_enabled == 1 and rows["B"].sync_enabled == 0
    assert rows["A"].monitoring_enabled == 1
    assert rows["A"].low_stock_threshold == 10
    assert rows["B"].available_units is None
