"""Steps that must not grow faster than their input: the keyed scan, the lookup of SKUs, landed files, the stock fold by slots."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockflow.operators import resolve, scan
from stockflow.sources import orders_json
from stockflow.sources import testdata as TD
from stockflow.streaming import keyed_ledger as K


def _rows(spark):
    rows = [(None if i % 50 == 7 else f"K{i % 5 if i % 3 else 0}", i, i % 4, i if i % 7 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at long, n long, m long")
    return df, {"sums": {"cum": F.col("n")}, "last_before": {"prev": F.when(F.col("m").isNotNull(), F.struct("m"))}}


@pytest.mark.parametrize("limit", [100, 10_000, 1])
@pytest.mark.parametrize("stamp", [True, False])
def test_keyed_scan_equals_the_scan_in_chunks(spark, monkeypatch, limit, stamp):
    """Some, none and all of the keys are cut into chunks; rows without a key take no part."""
    df, columns = _rows(spark)
    monkeypatch.setattr(scan, "HOT_ROWS", limit)
    hot = scan.hot_keys(df, ["k"])
    assert (hot is None) == (limit == 10_000)
    got = scan.keyed_scan(df, ["k"], "at", **columns, stamp=stamp, hot=hot)
    want = scan.ordered_scan(df, ["k"], "at", **columns, chunks=9, stamp=stamp).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 588


def test_rows_of_a_keyed_scan_move_once(spark):
    df, columns = _rows(spark)
    plan = scan.keyed_scan(df, ["k"], "at", **columns, stamp=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_line_meets_one_join(spark):
    """Variant, Shopify SKU and Etsy SKU are looked up for the distinct keys."""
    items = spark.createDataFrame([(f"S{i}",) for i in range(6)], "internal_sku string")
    mapping = spark.createDataFrame([(f"S{i}", f"v{i}" if i % 2 else None, f"s{i // 2 * 2}", f"e{i}") for i in range(6)],
                                    "internal_sku string, shopify_variant_id string, shopify_sku string, etsy_sku string")
    rows = [(p, s, v, n) for n, (p, s, v) in enumerate([
        ("shopify", " s2 ", "v1"), ("shopify", " s2 ", "v9"), ("shopify", "s4", None), ("shopify", None, "v3"), ("shopify", None, None), ("shopify", " ", None),
        ("etsy", "e5 ", "v1"), ("etsy", "s2", None), ("etsy", None, "v1"), ("other", "s2", "v1"), (None, "s2", "v1"), ("shopify", "s4", None)])]
    lines = spark.createDataFrame(rows, "platform string, platform_sku string, variant_id string, n int")
    out = resolve.resolve_lines(lines, items, mapping)
    assert out.columns == [*lines.columns, "internal_sku"]
    assert [r.internal_sku for r in out.orderBy("n").collect()] == ["S1", "S2", "S4", "S3", None, None, "S5", None, None, None, None, "S4"]
    plan, joins = out._jdf.queryExecution().optimizedPlan(), 0
    while plan.children().size():
        joins += plan.nodeName() == "Join"
        plan = plan.children().apply(0)
    assert joins == 1


def test_lookups_gather_no_catalogue(spark):
    """The catalogue meets the keys asked for by key; the first of variant, Shopify SKU and Etsy SKU that is known counts."""
    items = spark.createDataFrame([("S1",), ("S2",), ("S3",), (None,)], "internal_sku string")
    mapping = spark.createDataFrame([("S2", "v", "s", "e"), ("S1", None, "s", "e"), ("S1", None, "s", "e"), ("S3", "v", "v", ""), ("S0", "w", "s", "e"), (None, "x", "x", "x")],
                                    "internal_sku string, shopify_variant_id string, shopify_sku string, etsy_sku string")
    rows = [("shopify", "s", "v", "S2"), ("shopify", "s", "w", "S1"), ("shopify", "s", None, "S1"), ("shopify", "v", "s", "S3"), ("shopify", "x", "x", None),
            ("etsy", " e ", "v", "S1"), ("etsy", "v", "v", None), ("etsy", "", None, None), ("shopify", "s", "v", "S2"), (None, None, None, None)]
    lines = spark.createDataFrame(rows, "platform string, platform_sku string, variant_id string, want string")
    out = resolve.resolve_lines(lines, items, mapping)
    assert sorted(map(str, out.select("platform", "platform_sku", "variant_id", "internal_sku").collect())) == sorted(
        map(str, lines.select("platform", "platform_sku", "variant_id", F.col("want").alias("internal_sku")).collect()))
    named = resolve._found(lines.select("platform", "platform_sku", "variant_id").distinct(), items, mapping)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_a_stream_looks_up_rows_without_a_key_everywhere(spark):
    """Line by line the same SKUs; rows that ask for none are dealt out over the join."""
    items = spark.createDataFrame([("S1",), ("S2",), ("S3",), (None,)], "internal_sku string")
    mapping = spark.createDataFrame([("S2", "v", "s", "e"), ("S1", None, "s", "e"), ("S3", "v", "v", ""), ("S0", "w", "s", "e"), (None, "x", "x", "x")],
                                    "internal_sku string, shopify_variant_id string, shopify_sku string, etsy_sku string")
    rows = [(i, p, s, v) for i, (p, s, v) in enumerate((p, s, v) for p in ("shopify", "etsy", "other", None) for s in ("s", " e ", "v", "x", "", " ", None) for v in ("v", "w", "x", None))]
    lines = spark.createDataFrame(rows, "n int, platform string, platform_sku string, variant_id string")
    one = resolve._one_by_one(lines, items, mapping)
    assert one.columns == [*lines.columns, "internal_sku"]
    assert sorted(map(str, one.collect())) == sorted(map(str, resolve.resolve_lines(lines, items, mapping).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resolve._one_by_one(lines, items, mapping)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
    assert len(joins) == 2 and all("_salt" in line for line in joins)


VALUES = ['"A"', '""', "0", "0.0", "-0", "0e5", "00", '"0"', '"false"', "false", "true", "null", "7", "-0.5", "0.5", '"0x"', '" "', "[]", '{"a": 1}', "1e3", '"-0"']


def test_false_values_of_a_field(spark):
    """As JavaScript takes them, whatever their text looks like."""
    docs = ['{"sku": %s}' % v for v in VALUES] + ["{}", "x", "[1]", '{"sku": "A"', '{"sku": "A", "sku": "B"}', '"sku"', "null", '{"Sku": "A"}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r.t for r in df.select("i", orders_json._truthy(F.col("d"), "sku").alias("t")).orderBy("i").collect()]
    told = {'"A"': "A", '"0"': "0", '"false"': "false", "true": "true", "7": "7", "-0.5": "-0.5", "0.5": "0.5", '"0x"': "0x", '" "': " ", "[]": "[]", '{"a": 1}': '{"a":1}', '"-0"': "-0"}
    for v, t in zip(VALUES, got, strict=False):
        assert v == "1e3" and float(t) == 1000 or t == told.get(v), (v, t)
    assert got[len(VALUES):] == [None] * 8


def test_landed_files_grow_with_the_table(spark, tmp_path):
    spark.range(950).write.parquet(f"{tmp_path}/orders.parquet")
    assert TD.file_count(spark, str(tmp_path), 6, rows_a_file=100) == 10 and TD.file_count(spark, str(tmp_path), 6) == 6
    rows = spark.range(950).select(F.col("id").alias("o"), F.col("id").cast("string").alias("value"))
    path = TD.land_text(rows, ["o"], f"{tmp_path}/landed", TD.file_count(spark, str(tmp_path), 6, rows_a_file=100))
    files = sorted((tmp_path / "landed").glob("part-*"))
    assert len(files) == 10 and [int(n) for f in files for n in f.read_text().split()] == list(range(950)) and path


class Map(dict):
    exists = dict.__len__
    getValue = dict.get
    updateValue = dict.__setitem__


def fold(state, rows):
    p = K.StockFold()
    p.stock = state
    names = [c.split()[0] for c in K.CHANGE.split(", ")]
    frames = [pd.DataFrame(rows[i::2], columns=names) for i in range(2) if rows[i::2]]
    out = pd.concat(list(p.handleInputRows((0,), iter(frames), None)), ignore_index=True)
    return sorted(json.dumps([None if pd.isna(v) else str(v) for v in r]) for r in out.itertuples(index=False))


def test_stock_fold_of_many_skus_in_one_call():
    """A call with the rows of many SKUs gives what one call a SKU gives, and leaves the same state."""
    def sale(sku, t, q):
        return (sku, pd.Timestamp(2020, 1, t), 1, t, 0, None, None, "sale", q, None, None, None, "shopify", "o", "n")

    def stock(sku, t, units, tier):
        return (sku, pd.Timestamp(2020, 1, t), 0, t, None, None, None, "import", None, units, tier, 1, None, None, None)

    runs = [[stock("A", 1, 9, "tier1"), sale("A", 2, 3), sale("B", 1, 2), stock("B", 3, None, None), sale("B", 4, 1), sale("C", 1, 5), sale("A", 3, 4)],
            [sale("B", 5, 2), stock("A", 5, 7, None), sale("A", 4, 1), sale("A", 6, 2), sale("C", 2, 1), stock("D", 1, 3, "tier2"), sale(None, 2, 1)]]
    together, alone = Map(), Map()
    for rows in runs:
        one = sorted(sum((fold(alone, [r for r in rows if r[0] == sku]) for sku in dict.fromkeys(r[0] for r in rows)), []))
        assert fold(together, rows) == one and len(one) == len(rows)
        assert together == alone
    assert together[("A",)] == (7, None, 1, 2) and together[("B",)] == (None, None, 1, 3) and ("C",) not in together
