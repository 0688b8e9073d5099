"""The keyed stream: any split into runs gives what one batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from stockflow.operators import ledger
from stockflow.sources import orders_json
from stockflow.streaming import keyed_ledger as K

ITEM = "internal_sku string, product_name string, tier string, sync_enabled int, monitoring_enabled int, available_units long, low_stock_threshold long, units_per_pack long, notes string"
MAPPING = ("internal_sku string, shopify_sku string, shopify_variant_id string, shopify_inventory_item_id string, shopify_location_id string, "
           "etsy_sku string, etsy_listing_id string, etsy_offering_id string")


def feeds(spark):
    """Deliveries (some repeated) and imports, each with the run in which it lands."""
    rnd = random.Random(3)
    names = [f"S{i}" for i in range(6)]
    docs = []
    for i in range(180):
        lines = ", ".join('{"sku": "%s", "quantity": %s}' % (rnd.choice([*names, "unknown"]), rnd.choice([1, 2, 7, 0, 2.5])) for _ in range(rnd.randrange(4)))
        docs.append((i // 60, i, '{"id": %d, "line_items": [%s]}' % (i, lines)))
    docs += [(min(2, run + rnd.randrange(3)), 1000 + i, text) for run, i, text in docs[::3]]
    raw = spark.createDataFrame(docs, "run int, pos long, value string")
    raw = raw.withColumn("arrival", F.struct(F.col("run").cast("long").alias("batch"), F.col("pos").alias("doc_pos")))
    ts = F.timestamp_seconds(F.col("arrival.batch") * 100 + 50).cast("timestamp_ntz")
    documents, lines = orders_json.shopify_documents(raw, ts=ts)
    orders = K.deliveries(documents, lines)
    imports = [(run, f"S{i}", rnd.choice([None, 20, 5]), rnd.choice(["tier1", "tier2"]), 1) for run in (0, 2) for i in range(run, 6)]
    imports = spark.createDataFrame(imports, "run int, internal_sku string, available_units long, tier string, sync_enabled int")
    seq = F.struct(F.timestamp_seconds(F.col("run") * 100).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_pos"),
                   *[F.lit(None).cast(t).alias(n) for n, t in (("line_pos", "long"), ("tie1", "long"), ("tie2", "double"))])
    stock = K.import_feed(imports.withColumn("seq", seq))
    items = spark.createDataFrame([(n, n, "tier1", 1, 1, 0, 10, None, None) for n in names], ITEM)
    mapping = spark.createDataFrame([(n, n, None, None, None, n, None, None) for n in names], MAPPING)
    return orders.cache(), stock.cache(), items, mapping


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    orders, stock, items, mapping = feeds(spark)
    led = {}
    for name, splits in (("one", [(0, 1, 2)]), ("three", [(0,), (1,), (2,)])):
        root = str(tmp_path_factory.mktemp(name))
        for i, runs in enumerate(splits):
            orders.where(F.col("batch").isin(*runs)).coalesce(2).write.parquet(f"{root}/orders/{i}")
            stock.where(F.expr(f"unix_seconds(cast(ts AS timestamp)) div 100 IN {(*runs, -1)}")).coalesce(1).write.parquet(f"{root}/imports/{i}")
            # Every run is a new query on the same checkpoint: a restart.
            query, store = K.start(spark, f"{root}/orders/*", f"{root}/imports/*", items, mapping, f"{root}/store", f"{root}/checkpoint", state_partitions=2)
            query.awaitTermination()
        led[name] = (root, store)
    return led


def rows(store):
    return sorted(map(str, store.read("ledger").drop("batch_id").collect()))


def test_three_runs_equal_one(runs):
    one, three = rows(runs["one"][1]), rows(runs["three"][1])
    assert [r for r in one if r not in three] == [r for r in three if r not in one] == [] and len(one) > 60


def test_equal_to_the_batch_plan(spark, runs):
    orders, stock, items, mapping = feeds(spark)
    first = orders.groupBy("platform", "external_event_id").agg(F.min(F.struct(*K.ARRIVAL)).alias("a"))
    won = orders.join(first, ["platform", "external_event_id"]).where(F.struct(*K.ARRIVAL) == F.col("a"))
    lines = won.select("platform", "external_order_id", "note", F.explode(F.from_json("lines", f"array<{K._LINE}>")).alias("l")).select("platform", "external_order_id", "note", "l.*")
    from stockflow.operators import resolve
    from stockflow.plans.ingest import valid_line

    sales = ledger.sale_rows(resolve.resolve_lines(lines, items, mapping).where(valid_line()))
    imports = stock.select("internal_sku", F.struct(*K.SEQ).alias("seq"), *ledger.CHANGE_COLUMNS[2:])
    want = ledger.ledger_rows(ledger.apply_changes(sales.unionByName(imports)))
    assert sorted(map(str, want.collect())) == rows(runs["three"][1])


def test_a_run_without_new_events_leaves_the_state_alone(spark, runs):
    """A replay of everything: no ledger row, and the stock state as before."""
    root, store = runs["three"]
    orders, _, items, mapping = feeds(spark)
    before = rows(store)
    orders.withColumn("batch", F.lit(9).cast("long")).coalesce(1).write.parquet(f"{root}/orders/9")
    query, _ = K.start(spark, f"{root}/orders/*", f"{root}/imports/*", items, mapping, f"{root}/store", f"{root}/checkpoint", state_partitions=2)
    query.awaitTermination()
    assert rows(store) == before
    updated = [s.numRowsUpdated for p in query.recentProgress for s in p.stateOperators]
    assert updated and sum(updated) == 0


def test_first_arrivals_are_looked_up_by_the_engine(spark, tmp_path):
    """Of a micro-batch the earliest delivery counts, of all micro-batches the first; no event costs a call from Python."""
    names = K.DELIVERY
    runs = [[("shopify", "a", "1", "late", 1, 5, None, "[]"), ("shopify", "a", "1", "early", 1, 2, None, "[]"), ("etsy", "a", "2", "other", 1, 9, 1, "[]"), (None, "a", "3", "x", 1, 1, None, None),
             ("etsy", "a", "2", "paged", 1, 9, None, None)],
            [("shopify", "a", "1", "again", 0, 0, None, "[]"), ("shopify", "b", "4", "new", 2, (1 << 60) + 1, None, None), ("shopify", "b", "4", "first", 2, 1 << 60, None, None), (None, "a", "3", "y", 0, 0, None, None)]]
    told = []
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/orders/{i}")
        own = spark.newSession()
        own.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKSDB)
        first = K.first_arrivals(own.readStream.schema(names).parquet(f"{tmp_path}/orders/*"))
        query = first.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(
            lambda df, _: told.append(sorted(r.note for r in df.collect())) and None).start()
        query.awaitTermination()
        assert [s.operatorName for p in query.recentProgress for s in p.stateOperators] == ["dedupe"]
    assert told == [["early", "paged", "x"], ["first"]]
