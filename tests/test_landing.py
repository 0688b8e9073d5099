"""Landed files: places, the source registry, live ingest of two sources."""

import json

import pytest
from pyspark.sql import functions as F

from stockflow.functions.hmac import hmac_sha256_base64
from stockflow.operators import outbox
from stockflow.plans.book import StockBook
from stockflow.sources import landing, orders_json
from stockflow.store import TableStore
from stockflow.streaming import live_ingest

SECRET = "a key of this test"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def small_blocks(spark):
    """Files of a few hundred bytes are read in many blocks, by several tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(old, ("97b", "10b"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_places_follow_the_file_however_it_is_split(spark, tmp_path, small_blocks):
    for name in ("b.json", "a.json"):
        write(tmp_path / "in" / name, *(json.dumps({"id": f"{name}-{i}", "pad": "x" * (i * 7 % 50)}) for i in range(120)))
    rows = landing.SOURCES["shopify_orders"].read(spark, str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() > 10
    got = landing.with_arrival(rows, 3).select("arrival", F.get_json_object("value", "$.id").alias("id")).collect()
    assert len({r.arrival for r in got}) == 240 and {r.arrival.batch for r in got} == {3}
    assert [r.id for r in sorted(got, key=lambda r: r.arrival.doc_pos)] == [f"{n}.json-{i}" for n in "ab" for i in range(120)]


def test_the_last_row_of_an_import_wins_over_files_and_blocks(spark, tmp_path, small_blocks):
    head = "internal_sku,available_units,notes"
    for n, name in enumerate(("1.csv", "2.csv")):
        write(tmp_path / "in" / name, head, *(f"S{i % 7},{n * 1000 + i},row {i}" for i in range(100)))
    book = StockBook(spark, default_location="LOC")
    book.import_inventory_rows(spark.read.option("header", True).csv(str(tmp_path / "in")))
    assert {r.internal_sku: r.available_units for r in book.items.collect()} == {f"S{i % 7}": 1000 + i for i in range(93, 100)}
    assert book.ledger.count() == 200
    # The configured location stands where the file has none (PRJ-8).
    assert {r.shopify_location_id for r in book.mapping.collect()} == {"LOC"}


def test_receipts_of_a_page_apply_one_after_the_other(spark):
    page = json.dumps({"results": [{"receipt_id": 1, "transactions": [{"sku": "A", "quantity": 2}, {"sku": "A", "quantity": 3}]},
                                   {"receipt_id": 2, "transactions": [{"sku": "A", "quantity": 4}]}]})
    raw = spark.createDataFrame([(page, (1, 0))], "value string, arrival struct<batch:bigint,doc_pos:bigint>")
    _, lines = orders_json.etsy_documents(raw, enveloped=True)
    got = sorted((r.seq, r.quantity, r.i) for r in lines.withColumn("i", orders_json.line_index(F.col("seq.line_pos"))).collect())
    assert [(q, i) for _, q, i in got] == [(2, 0), (3, 1), (4, 0)]


def test_transactions_that_are_no_array(spark):
    docs = ['{"receipt_id": 1, "transactions": "x", "Transactions": [{"sku": "A", "quantity": 1}]}', '{"receipt_id": 2, "transactions": {"a": 1}}']
    raw = spark.createDataFrame([(d, (1, i)) for i, d in enumerate(docs)], "value string, arrival struct<batch:bigint,doc_pos:bigint>")
    documents, lines = orders_json.etsy_documents(raw)
    assert documents.count() == 2 and [r.platform_sku for r in lines.collect()] == ["A"]


def test_an_id_that_is_no_number_does_not_stop_the_others(spark):
    schema = "job_id long, internal_sku string, platform string, target_quantity long, skip_reason string, route_id string, route_sub_id string"
    jobs = [(1, "A", "shopify", 5, None, "gid-0", "9"), (2, "B", "etsy", 6, None, "1", "x"), (3, "C", "shopify", 7, None, "12", "34")]

    def sink(pdf):
        return pdf.assign(ok=[b"null" not in b.encode() for b in pdf["body"]], error=pdf["body"])

    got = {r.job_id: (r.ok, r.error) for r in outbox.deliver(spark.createDataFrame(jobs, schema), sink).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [False, False, True]
    assert json.loads(got[1][1]) == {"inventory_item_id": None, "location_id": 9, "available": 5}


def land_hooks(spark, path, bodies):
    rows = spark.createDataFrame([(b, good) for b, good in bodies], "b string, good boolean").coalesce(1)
    sig = F.when(F.col("good"), hmac_sha256_base64(F.col("b"), SECRET)).otherwise(hmac_sha256_base64(F.col("b"), "another"))
    rows.select(F.col("b").cast("binary").alias("body"), sig.alias("signature")).write.parquet(path)


def order(i, n, sku="A"):
    return json.dumps({"id": i, "line_items": [{"sku": sku, "quantity": n}]})


def test_two_live_sources_through_restart_and_replay(spark, tmp_path):
    write(tmp_path / "inv" / "1.csv", "internal_sku,tier,sync_enabled,available_units,shopify_sku,etsy_sku", "A,tier1,1,100,A,A", "B,tier2,0,50,B,B")
    root = f"{tmp_path}/store"
    store = TableStore(spark, root)
    assert live_ingest.publish_import(store, str(tmp_path / "inv"), 0)
    assert not live_ingest.publish_import(store, str(tmp_path / "inv"), 0)
    folders = {"shopify_webhook": f"{tmp_path}/hooks/*", "etsy_pages": f"{tmp_path}/pages"}

    def run(checkpoint="ckpt"):
        query, _ = live_ingest.start(spark, folders, root, f"{tmp_path}/{checkpoint}", secret=SECRET, first_number=1, files_per_trigger=1)
        query.awaitTermination()

    land_hooks(spark, f"{tmp_path}/hooks/1", [(order(1, 2), True), (order(2, 5), False), ("{broken", True), ('{"name": "no id"}', True), (order(3, 1, "B"), True)])
    write(tmp_path / "pages" / "1.json", json.dumps({"results": [{"receipt_id": 7, "transactions": [{"sku": "A", "quantity": 4}]}]}), "no json")
    run()
    stock = lambda: {r.internal_sku: r.available_units for r in store.read("items").collect()}
    assert stock() == {"A": 94, "B": 49}
    assert store.read("rejected").count() == 1 and store.read("malformed").count() == 2
    # The same bodies and the same page again, and one new order: only that takes effect.
    land_hooks(spark, f"{tmp_path}/hooks/2", [(order(1, 2), True), (order(4, 10), True)])
    write(tmp_path / "pages" / "2.json", json.dumps({"results": [{"receipt_id": 7, "transactions": [{"sku": "A", "quantity": 4}]}]}))
    run()
    assert stock() == {"A": 84, "B": 49}
    outcomes = {(r.platform, r.status): r["count"] for r in store.read("outcomes").groupBy("platform", "status").count().collect()}
    assert outcomes == {("shopify", "processed"): 3, ("shopify", "duplicate"): 1, ("etsy", "processed"): 1, ("etsy", "duplicate"): 1}
    events = store.read("events").collect()
    assert len(events) == 4 and all(e.processed == 1 and e.raw_payload for e in events) and store.read("event_items").count() == 4
    assert [(r.platform, r.target_quantity) for r in store.read("jobs").orderBy("platform").collect()] == [("etsy", 84), ("shopify", 84)]
    # A stream that has lost its checkpoint reads everything again; published batches are skipped.
    before = store.read("ledger").count()
    run("other")
    assert stock() == {"A": 84, "B": 49} and store.read("ledger").count() == before


def test_the_book_reads_landed_files(spark, tmp_path):
    write(tmp_path / "o" / "1.json", order(1, 2), order(1, 9), order(2, 3))
    book = StockBook(spark)
    book.import_inventory_rows([{"internal_sku": "A", "available_units": "20", "shopify_sku": "A"}])
    got = book.ingest_shopify_orders(landing.SOURCES["shopify_orders"].read(spark, str(tmp_path / "o")))
    assert sorted((r.external_order_id, r.status) for r in got.collect()) == [("1", "duplicate"), ("1", "manual"), ("2", "manual")]
    assert book.items.first().available_units == 15
