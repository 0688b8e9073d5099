import os
import tempfile

from pyspark.sql import functions as F

from stockflow.functions import normalize as N
from stockflow.plans.book import StockBook
from stockflow.sources.inventory_csv import read_inventory_csv
from stockflow.store import TableStore


def test_inventory_csv_ragged_and_blank_lines(spark):
    d = tempfile.mkdtemp(prefix="stockflow-csv-", dir="/tmp")
    path = os.path.join(d, "inv.csv")
    with open(path, "w") as f:
        f.write("internal_sku, tier ,available_units,low_stock_threshold,notes\n")
        f.write("  A1 , TIER1 , 12 ,3, fragile \n")
        f.write("\n")
        f.write("B2,tier2\n")
        f.write('C3,tier3,"7",,x,extra\n')
    raw = read_inventory_csv(spark, path)
    assert raw.columns == ["internal_sku", "tier", "available_units", "low_stock_threshold", "notes"]
    rows = {r.internal_sku: r for r in N.import_rows(raw).collect()}
    assert set(rows) == {"A1", "B2", "C3"}
    assert rows["A1"].tier == "tier1" and rows["A1"].available_units == 12 and rows["A1"].notes == "fragile"
    assert rows["A1"].sync_enabled == 1  # column absent: tier1 syncs
    assert rows["B2"].available_units is None and rows["B2"].low_stock_threshold == 10
    # No quoting: the quote characters stay part of the cell, which is then not a number.
    assert rows["C3"].available_units is None


def test_store_publish_is_atomic_and_replay_safe(spark):
    root = tempfile.mkdtemp(prefix="stockflow-store-", dir="/tmp")
    store = TableStore(spark, root)
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    assert store.publish(0, state={"s": a}, append={"log": a})
    assert not store.publish(0, state={"s": a.withColumn("v", F.lit("changed"))}, append={"log": a})
    b = spark.createDataFrame([(2, "y")], "k long, v string")
    assert store.publish(1, state={"s": b}, append={"log": b})
    assert [r.v for r in store.read("s").collect()] == ["y"]
    assert sorted(r.k for r in store.read("log").collect()) == [1, 2]
    empty = spark.createDataFrame([], "k long, v string")
    assert store.publish(2, append={"other": empty})
    assert store.read("other").count() == 0


def test_reset_and_seed(spark):
    book = StockBook(spark)
    assert book.seed_if_empty([dict(internal_sku="S1", tier="tier2", available_units="5")])
    assert not book.seed_if_empty([dict(internal_sku="S2", tier="tier2", available_units="5")])
    book.ingest_shopify_orders([{"id": 1, "name": "#1", "line_items": [{"sku": "S1", "quantity": 1}]}])
    assert book.events.collect()[0].processed == 1
    book.reset([dict(internal_sku="S3", tier="tier2", available_units="9")])
    assert [r.internal_sku for r in book.items.collect()] == ["S3"]
    assert book.events.count() == 0 and book.ledger.count() == 1
