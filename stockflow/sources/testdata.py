"""Driver test tables -> the reference's input shapes.

``part`` becomes the inventory file (all text cells, with messy spellings),
``orders`` become order documents of two channels (with replayed deliveries)
and ``lineitem`` becomes their order lines. Every rule is integer arithmetic
on the keys so that the DuckDB oracle can state the same rule in SQL.

Rules (p = p_partkey, o = o_orderkey, l = lineitem row):

* inventory: sku ``SKU-p``; tier ``tier(p%3+1)`` spelled `` TIER1 `` when
  p%5=0 and ``platinum`` (-> tier3) when p%29=7; sync flag for tier1 with
  p%4<>3 (``yes`` / `` 1`` / ``True``), blank when p%7=0 else ``no``;
  monitoring ``0`` when p%11=0, blank when p%13=5, else ``y``; units
  ``p_size*40``, blank when p%9=2, ``n/a`` when p%41=4, ``<units>.7`` when
  p%37=3; threshold ``10+p%50``, blank when p%19=0; pack ``6`` when p%4=1;
  notes ``fragile`` when p%8=0; mapping ids per FIXTURES.md, Shopify SKU
  ``SKU-(p-1)`` when p%25=24 (an ambiguous key).
* recount import at 1998-06-01 for p%6=1 with units ``p_size*10`` (blank
  when p%18=1); the first import is at 1990-01-01.
* documents: etsy when o%3=0 else shopify; delivery 2 repeats o%5=0.
* lines: channel SKU ``X-partkey`` when l_partkey%17=5, padded `` SKU-k ``
  when l_linenumber%3=1, else ``SKU-k``; Shopify variant ``100000+k`` when
  l_linenumber is even; quantity ``0`` when o%97=0, ``2.5`` when o%89=0,
  else the whole ``l_quantity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.functions import normalize as N
from stockflow.store import by_key

#: Error of an attempt that the fixture lets fail.
REFUSED = "delivery refused by the fixture"

INITIAL_IMPORT_TS = "1990-01-01 00:00:00"
RECOUNT_IMPORT_TS = "1998-06-01 00:00:00"
LATE_IMPORT_TS = "1995-01-01 00:00:00"
MOVED_TS = "1997-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def inventory_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory file: one text row per part."""
    p = F.col("p_partkey")
    base_tier = F.concat(F.lit("tier"), _s(p % 3 + 1))
    tier_raw = (
        F.when(p % 29 == 7, F.lit("platinum"))
        .when(p % 5 == 0, F.concat(F.lit(" "), F.upper(base_tier), F.lit(" ")))
        .otherwise(base_tier)
    )
    sync_raw = (
        F.when((p % 3 == 0) & (p % 4 != 3),
               F.when(p % 4 == 0, F.lit("yes")).when(p % 4 == 1, F.lit(" 1")).otherwise(F.lit("True")))
        .when(p % 7 == 0, F.lit(""))
        .otherwise(F.lit("no"))
    )
    monitor_raw = F.when(p % 11 == 0, F.lit("0")).when(p % 13 == 5, F.lit("")).otherwise(F.lit("y"))
    units = F.col("p_size").cast("long") * 40
    units_raw = (
        F.when(p % 9 == 2, F.lit(""))
        .when(p % 41 == 4, F.lit("n/a"))
        .when(p % 37 == 3, F.concat(_s(units), F.lit(".7")))
        .otherwise(_s(units))
    )
    sku = F.concat(F.lit("SKU-"), _s(p))
    return table(spark, sf_dir, "part").select(
        sku.alias("internal_sku"),
        F.col("p_name").alias("product_name"),
        tier_raw.alias("tier"),
        sync_raw.alias("sync_enabled"),
        monitor_raw.alias("monitoring_enabled"),
        units_raw.alias("available_units"),
        F.when(p % 19 == 0, F.lit("")).otherwise(_s(10 + p % 50)).alias("low_stock_threshold"),
        F.when(p % 4 == 1, F.lit("6")).otherwise(F.lit("")).alias("units_per_pack"),
        F.when(p % 8 == 0, F.lit("fragile")).otherwise(F.lit("")).alias("notes"),
        F.when(p % 10 == 9, F.lit(""))
        .when(p % 25 == 24, F.concat(F.lit("SKU-"), _s(p - 1)))
        .otherwise(sku).alias("shopify_sku"),
        F.when(p % 4 == 0, F.lit("")).otherwise(_s(100000 + p)).alias("shopify_variant_id"),
        F.when(p % 13 == 0, F.lit("")).otherwise(_s(200000 + p)).alias("shopify_inventory_item_id"),
        F.when(p % 13 == 1, F.lit("")).otherwise(F.lit("1")).alias("shopify_location_id"),
        F.when(p % 7 == 6, F.lit("")).otherwise(sku).alias("etsy_sku"),
        F.when(p % 13 == 2, F.lit("")).otherwise(_s(300000 + p)).alias("etsy_listing_id"),
        F.when(p % 13 == 3, F.lit("")).otherwise(_s(400000 + p)).alias("etsy_offering_id"),
        p.alias("_row"),
    )


def _import_seq(ts: str, row: Column) -> Column:
    return F.struct(
        F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("kind"),
        row.cast("long").alias("doc_pos"), F.lit(None).cast("long").alias("line_pos"),
        F.lit(None).cast("long").alias("tie1"), F.lit(None).cast("double").alias("tie2"),
    )


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both import files as raw rows with their ``seq``."""
    raw = inventory_raw(spark, sf_dir)
    first = raw.withColumn("seq", _import_seq(INITIAL_IMPORT_TS, F.col("_row")))
    p = F.col("_row")
    recount_units = F.when(p % 18 == 1, F.lit("")).otherwise(
        _s(F.col("_size10")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_row"),
                                               (F.col("p_size").cast("long") * 10).alias("_size10"))
    second = (
        raw.filter(F.col("_row") % 6 == 1)
        .join(by_key(part), "_row")
        .withColumn("available_units", recount_units)
        .drop("_size10")
        .withColumn("seq", _import_seq(RECOUNT_IMPORT_TS, F.col("_row")))
    )
    return first.unionByName(second)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised import rows (items + mapping columns + ``seq``)."""
    return N.import_rows(import_files(spark, sf_dir)).drop("_row")


def initial_items_and_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items and mapping after the first import (the resolution dimension)."""
    norm = N.import_rows(inventory_raw(spark, sf_dir)).drop("_row")
    return norm.select(*S.ITEM_COLUMNS), norm.select(*S.MAPPING_COLUMNS)


def mapping_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings over time: a part is imported in 1990, or in 1995 when p%4=1;
    in 1997 parts p%6=1 give up their variant and take the Shopify SKU of p+1."""
    p = F.col("_row")
    norm = N.import_rows(inventory_raw(spark, sf_dir)).select("_row", *S.MAPPING_COLUMNS)

    def at(ts: str) -> Column:
        return _import_seq(ts, p)

    first = norm.withColumn("seq", F.when(p % 4 == 1, at(LATE_IMPORT_TS)).otherwise(at(INITIAL_IMPORT_TS)))
    moved = norm.where(p % 6 == 1).withColumn("shopify_variant_id", F.lit(None).cast("string")).withColumn(
        "shopify_sku", F.concat(F.lit("SKU-"), _s(p + 1))).withColumn("seq", at(MOVED_TS))
    return first.unionByName(moved).drop("_row")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    platform = F.when(o % 3 == 0, F.lit("etsy")).otherwise(F.lit("shopify"))
    oid = _s(o)
    shop_name = F.when(o % 7 != 3, F.concat(F.lit("#"), oid))
    etsy_name = F.when(o % 4 == 1, F.concat(F.lit("Receipt "), oid))
    name = F.when(platform == "shopify", shop_name).otherwise(
        F.coalesce(etsy_name, F.concat(F.lit(S.ETSY_NAME_PREFIX), oid)))
    status = F.when(platform == "shopify",
                    F.when(F.col("o_orderstatus") == "F", F.lit("paid"))
                    .otherwise(F.concat(F.lit("fulfillment-"), F.col("o_orderstatus")))
                    ).otherwise(F.col("o_orderpriority"))
    note = F.when(platform == "shopify",
                  F.concat(F.lit(S.SHOPIFY_NOTE_PREFIX), F.coalesce(shop_name, oid))
                  ).otherwise(F.concat(F.lit(S.ETSY_NOTE_PREFIX), oid))
    event = F.when(platform == "shopify", F.concat(F.lit(S.SHOPIFY_EVENT_PREFIX), oid)).otherwise(
        F.concat(F.lit(S.ETSY_EVENT_PREFIX), oid))
    return table(spark, sf_dir, "orders").select(
        o.alias("o_orderkey"),
        F.col("o_orderdate").alias("ts"),
        platform.alias("platform"),
        event.alias("external_event_id"),
        oid.alias("external_order_id"),
        name.alias("order_name"),
        status.alias("order_status"),
        note.alias("note"),
    )


def _with_deliveries(df: DataFrame) -> DataFrame:
    """Delivery 1 of every document, delivery 2 again for o%5=0 (one scan)."""
    times = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = df.select("*", F.explode(times).alias("delivery"))
    return out.withColumn("arrival", F.struct(F.col("delivery").cast("long").alias("batch"),
                                              F.col("o_orderkey").alias("doc_pos")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents as delivered (replays included)."""
    return _with_deliveries(_orders(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical order lines of every delivered document."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    ln = F.col("l_linenumber")
    o = F.col("o_orderkey")
    sku_raw = (
        F.when(k % 17 == 5, F.concat(F.lit("X-"), _s(k)))
        .when(ln % 3 == 1, F.concat(F.lit(" SKU-"), _s(k), F.lit(" ")))
        .otherwise(F.concat(F.lit("SKU-"), _s(k)))
    )
    qty_raw = (
        F.when(o % 97 == 0, F.lit("0"))
        .when(o % 89 == 0, F.lit("2.5"))
        .otherwise(_s(F.col("l_quantity").cast("long")))
    )
    qty, qty_ok = N.quantity(qty_raw)
    docs = _orders(spark, sf_dir)
    joined = li.join(docs, li["l_orderkey"] == docs["o_orderkey"])
    out = joined.select(
        "o_orderkey", "platform", "external_event_id", "external_order_id", "order_name",
        "order_status", "note",
        F.struct(
            F.col("ts").alias("ts"), F.lit(1).alias("kind"), o.alias("doc_pos"),
            ln.cast("long").alias("line_pos"), F.col("l_suppkey").alias("tie1"),
            F.col("l_extendedprice").alias("tie2"),
        ).alias("seq"),
        sku_raw.alias("platform_sku"),
        F.when((F.col("platform") == "shopify") & (ln % 2 == 0), _s(100000 + k)).alias("variant_id"),
        qty.alias("quantity"),
        qty_ok.alias("quantity_valid"),
        F.lit(None).cast("string").alias("unit_price"),
        F.concat(F.lit("line "), _s(ln)).alias("title"),
    )
    return _with_deliveries(out).drop("delivery")


# ------------------------------------------------------------------ outbox
NOW_MS = 1_700_000_000_000


def partkey_of(sku: Column) -> Column:
    return F.substring(sku, 5, 32).cast("long")


def outbox_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping seen by the dispatcher: rows absent when p%13=4."""
    _, mapping = initial_items_and_mapping(spark, sf_dir)
    return mapping.filter(partkey_of(F.col("internal_sku")) % 13 != 4)


def job_key(_df=None) -> Column:
    """Fixture job number: 2 * (partkey div 3) + (1 for etsy)."""
    pk = partkey_of(F.col("internal_sku"))
    return F.floor(pk / 3).cast("long") * 2 + F.when(F.col("platform") == "etsy", 1).otherwise(0)


def attempt_ok(attempt_no: Column) -> Column:
    """Fixture platform behaviour: attempt k of job j succeeds iff (j + k) % 6 = 0."""
    return (job_key(None) + attempt_no) % 6 == 0



def fixture_results(routed: DataFrame) -> DataFrame:
    """Attempt results of one dispatch round (attempt number = attempts + 1)."""
    ok = attempt_ok(F.col("attempts") + 1)
    return routed.filter(F.col("skip_reason").isNull()).select(
        "job_id", ok.alias("ok"), F.when(~ok, F.lit(REFUSED)).alias("error"))


def fixture_attempts(routed: DataFrame) -> DataFrame:
    """Results of attempts 1..max_attempts for every routed job (history)."""
    k = F.explode(F.sequence(F.lit(1), F.col("max_attempts").cast("int"))).alias("attempt_no")
    a = routed.select("job_id", "internal_sku", "platform", "skip_reason", k)
    ok = F.col("skip_reason").isNull() & attempt_ok(F.col("attempt_no"))
    return a.select("job_id", "skip_reason", "attempt_no", ok.alias("ok"),
                    F.when(~ok & F.col("skip_reason").isNull(), F.lit(REFUSED)).alias("error"))


# ------------------------------------------------------------------ reconcile faults
def ledger_with_faults(ledger: DataFrame) -> DataFrame:
    """Sale rows: change + 2 when doc_pos%17=0 (broken row); before and after
    + 1 when doc_pos%23=0 (a gap at this row and a broken row nowhere)."""
    sale = F.col("reason") == S.REASON_SALE
    d = F.col("seq.doc_pos")
    broken = sale & (d % 17 == 0)
    gap = sale & (d % 23 == 0)
    return ledger.withColumns({
        "change_units": F.when(broken, F.col("change_units") + 2).otherwise(F.col("change_units")),
        "before_units": F.when(gap, F.col("before_units") + 1).otherwise(F.col("before_units")),
        "after_units": F.when(gap, F.col("after_units") + 1).otherwise(F.col("after_units")),
    })


def items_with_drift(items: DataFrame) -> DataFrame:
    """Live stock edited out of band: - 15 when p%50=0."""
    p = partkey_of(F.col("internal_sku"))
    return items.withColumn("available_units", F.when(p % 50 == 0, F.col("available_units") - 15)
                            .otherwise(F.col("available_units")))


# ------------------------------------------------------------------ webhooks
WEBHOOK_SECRET = "signing key of the fixture"
WRONG_SECRET = "another key"


def signed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed Shopify payload per order: valid, wrong secret (o%11=0),
    missing signature (o%13=0) or tampered body (o%17=0)."""
    from stockflow.functions.hmac import hmac_sha256_base64

    o = F.col("o_orderkey")
    oid = _s(o)
    body = F.concat(F.lit('{"id":'), oid, F.lit(',"name":"#'), oid, F.lit('"}'))
    tampered = F.concat(F.lit('{"id":'), oid, F.lit(',"name":"#'), oid, F.lit('!"}'))
    case = (F.when(o % 13 == 0, F.lit("missing")).when(o % 11 == 0, F.lit("wrong_secret"))
            .when(o % 17 == 0, F.lit("tampered")).otherwise(F.lit("valid")))
    sig = (F.when(case == "missing", F.lit(None).cast("string"))
           .when(case == "wrong_secret", hmac_sha256_base64(body, WRONG_SECRET))
           .otherwise(hmac_sha256_base64(body, WEBHOOK_SECRET)))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit(S.SHOPIFY_EVENT_PREFIX), oid).alias("external_event_id"),
        case.alias("case"),
        F.when(case == "tampered", tampered).otherwise(body).cast("binary").alias("body"),
        sig.alias("signature"))


# ------------------------------------------------------------------ landed files
def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order as an array, in the order of their JSON array."""
    packed = F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(packed)).alias("_lines"))


def _line_json(o: Column, etsy: bool):
    """JSON text of one line: SKU spelled as in :func:`lines`; Etsy gives even
    line numbers as an array ``skus``; quantity 0 when o%97=0, 2.5 when o%89=0."""
    def of(x: Column) -> Column:
        k, n = _s(x["l_partkey"]), x["l_linenumber"]
        sku = (F.when(x["l_partkey"] % 17 == 5, F.concat(F.lit("X-"), k)).when(n % 3 == 1, F.concat(F.lit(" SKU-"), k, F.lit(" ")))
               .otherwise(F.concat(F.lit("SKU-"), k)))
        qty = F.when(o % 97 == 0, F.lit("0")).when(o % 89 == 0, F.lit("2.5")).otherwise(_s(x["l_quantity"].cast("long")))
        rest = F.concat(F.lit('"quantity":'), qty, F.lit(',"price":"'), _s(x["l_partkey"] % 100), F.lit('.50","title":"line '), _s(n), F.lit('"}'))
        if etsy:
            key = F.when(n % 2 == 0, F.concat(F.lit('{"skus":["'), sku, F.lit('"],'))).otherwise(F.concat(F.lit('{"sku":"'), sku, F.lit('",')))
        else:
            variant = F.when(n % 2 == 0, _s(100000 + x["l_partkey"])).otherwise(F.lit("null"))
            key = F.concat(F.lit('{"sku":"'), sku, F.lit('","variant_id":'), variant, F.lit(","))
        return F.concat(key, rest)

    return of


def shopify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, delivery, value``: Shopify orders (o%3<>0) as JSON text.

    No id when o%101=0; cut off when o%103=0; two elements that are no objects
    at the end of ``line_items`` when o%19=0; delivery 2 repeats o%5=0 under
    another name."""
    o = F.col("o_orderkey")
    oid = _s(o)
    docs = table(spark, sf_dir, "orders").where(o % 3 != 0).join(_order_lines(spark, sf_dir), o == F.col("l_orderkey"), "left")
    times = F.when(o % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    docs = docs.select("*", F.explode(times).alias("delivery"))
    name = F.when(F.col("delivery") == 2, F.concat(F.lit('"name":"#'), oid, F.lit(' again",'))).when(
        o % 7 != 3, F.concat(F.lit('"name":"#'), oid, F.lit('",'))).otherwise(F.lit(""))
    status = F.when(F.col("o_orderstatus") == "F", F.lit('"financial_status":"paid","fulfillment_status":null,')).otherwise(
        F.concat(F.lit('"financial_status":null,"fulfillment_status":"fulfillment-'), F.col("o_orderstatus"), F.lit('",')))
    lines = F.concat_ws(",", F.transform(F.coalesce("_lines", F.array()), _line_json(o, False)), F.when(o % 19 == 0, F.lit('"oops",null')))
    whole = F.concat(F.lit("{"), F.when(o % 101 == 0, F.lit("")).otherwise(F.concat(F.lit('"id":'), oid, F.lit(","))), name, status,
                     F.lit('"line_items":['), lines, F.lit("]}"))
    return docs.select(o.alias("o_orderkey"), "delivery", F.when(o % 103 == 0, F.concat(F.lit('{"id":'), oid, F.lit(',"name":'))).otherwise(whole).alias("value"))


def etsy_pages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, value``: pages of eight Etsy receipts (o%3=0) as JSON text.

    A receipt is repeated inside its page under another name when o%5=0; its id
    stands under ``transaction_id`` when o%7=0 and nowhere when o%101=0; its
    lines stand under ``Transactions`` when o%2=0, beside a ``transactions``
    that is a text when o%10=0. Pages divisible by 13 come with an answer
    that has no receipts and one that is no JSON."""
    o = F.col("o_orderkey")
    oid = _s(o)
    docs = table(spark, sf_dir, "orders").where(o % 3 == 0).join(_order_lines(spark, sf_dir), o == F.col("l_orderkey"), "left")
    times = F.when(o % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    docs = docs.select("*", F.explode(times).alias("delivery"))
    key = F.when(o % 101 == 0, F.lit("")).when(o % 7 == 0, F.concat(F.lit('"receipt_id":null,"transaction_id":'), oid, F.lit(","))).otherwise(
        F.concat(F.lit('"receipt_id":'), oid, F.lit(",")))
    name = F.when(F.col("delivery") == 2, F.lit('"name":"again",')).when(o % 4 == 1, F.concat(F.lit('"name":"Receipt '), oid, F.lit('",'))).otherwise(F.lit(""))
    spelled = F.when(o % 10 == 0, F.lit('"transactions":"x","Transactions":[')).when(o % 2 == 0, F.lit('"Transactions":[')).otherwise(F.lit('"transactions":['))
    receipt = F.concat(F.lit("{"), key, name, F.lit('"status":"'), F.col("o_orderpriority"), F.lit('",'), spelled,
                       F.concat_ws(",", F.transform(F.coalesce("_lines", F.array()), _line_json(o, True))), F.lit("]}"))
    pages = docs.groupBy(F.floor(o / 24).alias("page")).agg(F.sort_array(F.collect_list(F.struct(o.alias("o"), "delivery", receipt.alias("r")))).alias("_r"))
    text = F.concat(F.lit('{"count":'), _s(F.size("_r")), F.lit(',"results":['), F.concat_ws(",", F.transform("_r", lambda x: x["r"])), F.lit("]}"))
    bad = F.when(F.col("page") % 13 == 0, F.array(F.lit('{"error":"later"}'), F.lit("oops"))).otherwise(F.array().cast("array<string>"))
    return pages.select("page", F.explode(F.concat(F.array(text), bad)).alias("value"))


def file_count(spark: SparkSession, sf_dir: str, least: int, table_name: str = "orders", rows_a_file: int = 200_000) -> int:
    """Landed files for the rows of a table: ``least``, and more as it grows."""
    return max(least, -(-table(spark, sf_dir, table_name).count() // rows_a_file))


def land_text(rows: DataFrame, order: list[str], path: str, files: int = 6) -> str:
    """``value`` as text files whose names, and lines, follow ``order``."""
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def signed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, delivery, body, signature``: the orders of
    :func:`shopify_json` as webhook deliveries. The signature is missing when
    o%13=0, made with another secret when o%11=0 and that of another body when
    o%17=0; delivery 2 is delivery 1 again, byte for byte."""
    from stockflow.functions.hmac import hmac_sha256_base64

    o = F.col("o_orderkey")
    sent = shopify_json(spark, sf_dir).where("delivery = 1").select(o, F.col("value").alias("body"))
    sig = (F.when(o % 13 == 0, F.lit(None).cast("string")).when(o % 11 == 0, hmac_sha256_base64(F.col("body"), WRONG_SECRET))
           .when(o % 17 == 0, hmac_sha256_base64(F.concat("body", F.lit(" ")), WEBHOOK_SECRET)).otherwise(hmac_sha256_base64(F.col("body"), WEBHOOK_SECRET)))
    times = F.when(o % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return sent.select(o, F.explode(times).alias("delivery"), F.col("body").cast("binary").alias("body"), sig.alias("signature"))


def inventory_files(spark: SparkSession, sf_dir: str, root: str) -> tuple[str, str]:
    """Two folders of CSV files: the inventory, and a recount of p%6=1 that
    names every SKU twice, first with five units too many."""
    raw = inventory_raw(spark, sf_dir)
    again = raw.where(F.col("_row") % 6 == 1).drop("available_units").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_row"), (F.col("p_size").cast("long") * 10).alias("_units")), "_row")
    again = again.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_time")).withColumn(
        "available_units", F.when(F.col("_time") == 1, _s(F.col("_units") + 5)).otherwise(F.when(F.col("_row") % 18 == 1, F.lit("")).otherwise(_s(F.col("_units")))))

    files = file_count(spark, sf_dir, 4, "part")

    def land(rows: DataFrame, order: list[str], path: str) -> str:
        out = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select(*S.INVENTORY_COLUMNS)
        out.write.option("header", True).option("quote", "\u0000").option("emptyValue", "").option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return path

    return land(raw, ["_row"], f"{root}/inventory"), land(again, ["_time", "_row"], f"{root}/recount")


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a landed attempt log: the user is the job, ``signup`` a
    requeue that took effect, ``purchase`` a delivery that succeeded, ``click``
    a skip when event_id%10=0, everything else a refused delivery."""
    e = F.col("event_type")
    skipped = (e == "click") & (F.col("event_id") % 10 == 0)
    ok = e == "purchase"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"),
        F.when(F.col("user_id") % 2 == 0, F.lit("shopify")).otherwise(F.lit("etsy")).alias("platform"),
        F.when(e == "signup", F.lit("requeue")).otherwise(F.lit("attempt")).alias("kind"), ok.alias("ok"),
        F.when(skipped, F.lit("no route")).alias("skip_reason"),
        F.when(~ok & ~skipped, F.concat(F.lit("refused: "), e)).alias("error"))
