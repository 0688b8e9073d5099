"""Readers, dedupe and reports on documents that are not as they should be."""

import base64
import hashlib
import hmac

from pyspark.sql import functions as F

from stockflow.operators import dedupe, outbox, reports
from stockflow.plans.book import StockBook
from stockflow.sources import orders_json, webhook
from stockflow.store import TableStore
from stockflow.streaming import ingest_stream, relay


def raw(spark, *texts):
    rows = [(t, (1, i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "value string, arrival struct<batch:bigint,doc_pos:bigint>")


def test_repeats_inside_one_page_win_once(spark):
    page = '{"results": [%s, %s, %s]}' % ('{"receipt_id": 5, "transactions": [{"sku": "A", "quantity": 1}]}',
                                          '{"receipt_id": 5, "transactions": [{"sku": "A", "quantity": 1}]}',
                                          '{"receipt_id": 6, "transactions": [{"sku": "B", "quantity": 2}]}')
    docs, lines = orders_json.etsy_documents(raw(spark, page), enveloped=True)
    out = dedupe.document_outcomes(docs)
    assert sorted((r.external_event_id, r.status) for r in out.collect()) == [
        ("etsy-receipt-5", "duplicate"), ("etsy-receipt-5", "processed"), ("etsy-receipt-6", "processed")]
    won = dedupe.winning_lines(lines, out.where("status = 'processed'"))
    assert sorted(r.platform_sku for r in won.collect()) == ["A", "B"]


def test_documents_without_an_id_are_quarantined(spark):
    docs, _ = orders_json.shopify_documents(raw(spark, '{"name": "x"}', '{"id": 1}', '{"id": 1}', "broken"))
    out = sorted((r.external_event_id or "", r.status, r.status_reason or "") for r in dedupe.document_outcomes(docs).collect())
    assert out == [("", "quarantined", "document without an id")] * 2 + [
        ("shopify-order-1", "duplicate", ""), ("shopify-order-1", "processed", "")]


ORDERS = ['{"name": "x", "line_items": [{"sku": "A", "quantity": 2}, {"sku": "B", "quantity": 1}]}', '{"id": 1, "line_items": [{"sku": "A", "quantity": 1}]}', "broken"]
STOCK = [{"internal_sku": "A", "available_units": "5"}]


def held(table):
    return sorted((r.raw_payload, [(x.platform_sku, x.quantity) for x in r.lines], r.status_reason) for r in table.collect())


HELD = sorted([(ORDERS[0], [("A", 2), ("B", 1)], "document without an id"), ("broken", [], "document without an id")])


def test_the_book_keeps_quarantined_documents(spark):
    book = StockBook(spark)
    book.import_inventory_rows(STOCK)
    book.ingest_shopify_orders(ORDERS)
    book.ingest_shopify_orders(ORDERS[1:2])
    assert held(book.quarantine) == HELD


def test_the_stream_keeps_quarantined_documents(spark, tmp_path):
    book = StockBook(spark)
    book.import_inventory_rows(STOCK)
    docs, lines = orders_json.shopify_documents(raw(spark, *ORDERS))
    store = TableStore(spark, str(tmp_path))
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in ingest_stream.IMPORT_COLS if c != "seq")).crossJoin(lines.select("seq").limit(0))
    store.publish(0, state={"items": book.items, "mapping": book.mapping})
    assert ingest_stream.process_batch(store, ingest_stream.change_feed(empty, docs, lines), 1)
    assert held(store.read("quarantine")) == HELD


def test_equal_arrivals_cannot_multiply(spark):
    docs = spark.createDataFrame([("p", "e", "o1", 1), ("p", "e", "o2", 1), ("p", "e", "o3", 2)],
                                 "platform string, external_event_id string, external_order_id string, arrival int")
    out = dedupe.document_outcomes(docs)
    assert sorted((r.external_order_id, r.status) for r in out.collect()) == [("o1", "processed"), ("o2", "duplicate"), ("o3", "duplicate")]
    store = docs.select("platform", "external_event_id").distinct()
    assert {r.status for r in dedupe.document_outcomes(docs, store).collect()} == {"duplicate"}


def test_a_bad_line_stays_a_line_of_its_own(spark):
    _, lines = orders_json.shopify_documents(raw(
        spark, '{"id": 1, "line_items": [{"sku": "A", "quantity": 2}, 5, {"sku": "B", "quantity": 3}]}', '{"id": 2, "line_items": 7}', '{"id": 3}'))
    got = sorted((r.seq.line_pos, r.platform_sku, r.quantity) for r in lines.select("seq", "platform_sku", F.coalesce("quantity", F.lit(-1)).alias("quantity")).collect())
    assert [g[0] for g in got] == [0, 1, 2] and got[0][1:] == ("A", 2) and got[1][1] is None and got[2][1:] == ("B", 3)
    # No SKU and nothing to sell: it will be reported as unresolved.
    assert got[1][2] <= 0


def test_truthiness_follows_the_type(spark):
    items = ",".join('{"sku": %s, "quantity": 1}' % v for v in ('"0"', '"false"', '"null"', "0", "0.0", "false", "null", '""', "7", "true"))
    _, lines = orders_json.shopify_documents(raw(spark, '{"id": 1, "line_items": [%s]}' % items))
    got = {r.seq.line_pos: r.platform_sku for r in lines.collect()}
    assert [got[i] for i in range(10)] == ["0", "false", "null", None, None, None, None, None, "7", "true"]


def test_channels_never_share_a_place(spark):
    a = orders_json.shopify_documents(raw(spark, '{"id": 1, "line_items": [{"sku": "A", "quantity": 1}]}'))
    b = orders_json.etsy_documents(raw(spark, '{"receipt_id": 1, "transactions": [{"sku": "A", "quantity": 1}]}'))
    _, lines = orders_json.union_channels(a, b)
    assert lines.select("seq").distinct().count() == lines.count() == 2


def test_malformed_webhook_bodies(spark):
    bodies = [b'{"id": 1}', b'{"id":2', b"{bad", b'{"name": "x"}', b"[1]", b'{"id": 3, "line_items": []}']
    rows = [(x, base64.b64encode(hmac.new(b"own-secret", x, hashlib.sha256).digest()).decode()) for x in bodies] + [(b'{"id": 9}', "no")]
    docs, rejected, malformed = webhook.parse_accepted(spark.createDataFrame(rows, "body binary, signature string"), "own-secret")
    assert sorted(r.doc.id for r in docs.collect()) == ["1", "3"]
    assert rejected.count() == 1 and sorted(bytes(r.body) for r in malformed.collect()) == sorted(bodies[1:5])


def test_undecodable_events_are_dropped(spark):
    msgs = spark.createDataFrame([("k", '{"job_id": 4, "internal_sku": "A"}'), ("k", "not json"), ("k", '{"job_id": "x"}'), ("k", None)], "key string, value string")
    assert [(r.job_id, r.internal_sku, r.target_quantity) for r in relay.decode_events(msgs).collect()] == [(4, "A", 0)]


def test_payload_ids_are_numbers(spark):
    row = spark.range(1).select(outbox.payload(F.lit("shopify"), F.lit("12"), F.lit("34"), F.lit(5)).alias("b")).first()
    assert row.b == '{"inventory_item_id":12,"location_id":34,"available":5}'


def test_reports_keep_what_is_asked_for(spark):
    assert reports.recent(spark.range(1000), ["id"], 500).count() == 500
    runs = spark.createDataFrame([(1, "drift"), (2, "clean")], "run_id long, label string")
    items = spark.createDataFrame([("A", 3, 1, 5)], "internal_sku string, available_units long, monitoring_enabled int, low_stock_threshold long")
    assert reports.kpis(items, spark.createDataFrame([], "status string"), runs).first().last_run_label == "clean"
