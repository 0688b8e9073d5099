"""Table schemas, enums and fixed values.

The canonical total order of every change is the struct column ``seq``:
``(ts, kind, doc_pos, line_pos, tie1, tie2)``. ``kind`` 0 = import, 1 = sale,
so an import sorts before a sale of the same instant. Sources fill
``doc_pos`` / ``line_pos`` from file offset / array index; the test-table
adapter fills them from the order and line keys.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
TIERS = ["tier1", "tier2", "tier3"]
DEFAULT_TIER = "tier3"
TRUTHY_FLAGS = ["1", "true", "yes", "y"]
DEFAULT_LOW_STOCK_THRESHOLD = 10
PLATFORMS = ["shopify", "etsy"]
SHOPIFY_EVENT_PREFIX = "shopify-order-"
ETSY_EVENT_PREFIX = "etsy-receipt-"
ETSY_NAME_PREFIX = "etsy-"
SHOPIFY_NOTE_PREFIX = "Shopify order "
ETSY_NOTE_PREFIX = "Etsy receipt "
REASON_SALE = "sale"
REASON_IMPORT = "import_snapshot"
NOTE_INITIAL_IMPORT = "initial import"
NOTE_IMPORT_CHANGED = "import changed units"
OVERSELL_NOTE_FORMAT = "[oversell: requested %d, only %d available]"
PUSH_RETRY_BASE_MS = 5000
PUSH_MAX_ATTEMPTS = 5
CLAIM_LEASE_MS = 30_000
RECENT_DEFAULT_LIMIT = 50
DUE_BATCH_LIMIT = 50
RECONCILE_RUNS_LIMIT = 20
SKIP_PUSH_DISABLED = "ENABLE_PLATFORM_PUSH=false"
SKIP_NO_MAPPING = "no SKU mapping found"
SKIP_SHOPIFY_ROUTE = "missing Shopify inventory mapping"
SKIP_ETSY_ROUTE = "missing Etsy mapping / offering id"
LOG_SUCCESS_FORMAT = "%s inventory updated (attempt %d)"
LOG_RETRY_FORMAT = "attempt %d failed, retry in %dms: %s"
LOG_DEAD_FORMAT = "dead-lettered after %d attempts: %s"
STATUS_MESSAGES = {
    "unresolved": "no internal SKU mapping found or invalid quantity",
    "no_unit_stock": "this SKU has no reliable unit-level stock; order recorded but not auto-decremented",
    "enqueued": "tier1 SKU: stock decremented, write-back deferred to the worker pipeline",
    "synced_oversold": "tier1 SKU: oversold, stock clamped to 0 and write-back attempted",
    "synced": "tier1 SKU: stock decremented and write-back attempted",
    "tier2": "tier2 SKU: internal stock/trend recorded, no write-back",
    "tier3": "tier3 SKU: manual workflow kept, no write-back",
}
# ---------------------------------------------------------------------------

JOB_STATUSES = ["pending", "succeeded", "skipped", "dead_letter"]
LOG_STATUSES = ["success", "failed", "skipped"]

SEQ = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("doc_pos", T.LongType()),
    T.StructField("line_pos", T.LongType()),
    T.StructField("tie1", T.LongType()),
    T.StructField("tie2", T.DoubleType()),
])

# Raw inventory file row: every cell is text.
INVENTORY_COLUMNS = [
    "internal_sku", "product_name", "tier", "sync_enabled", "monitoring_enabled",
    "available_units", "low_stock_threshold", "units_per_pack", "notes",
    "shopify_sku", "shopify_variant_id", "shopify_inventory_item_id", "shopify_location_id",
    "etsy_sku", "etsy_listing_id", "etsy_offering_id",
]
ITEM_COLUMNS = [
    "internal_sku", "product_name", "tier", "sync_enabled", "monitoring_enabled",
    "available_units", "low_stock_threshold", "units_per_pack", "notes",
]
MAPPING_COLUMNS = [
    "internal_sku", "shopify_sku", "shopify_variant_id", "shopify_inventory_item_id",
    "shopify_location_id", "etsy_sku", "etsy_listing_id", "etsy_offering_id",
]

SHOPIFY_LINE = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("variant_id", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("title", T.StringType()),
])
SHOPIFY_ORDER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("financial_status", T.StringType()),
    T.StructField("fulfillment_status", T.StringType()),
    T.StructField("line_items", T.ArrayType(SHOPIFY_LINE)),
])
ETSY_LINE = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("skus", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("title", T.StringType()),
])

# Canonical order line, the common shape of both channels after SET-1.
LINE_COLUMNS = [
    "platform", "external_event_id", "external_order_id", "order_name", "order_status",
    "note", "arrival", "seq", "platform_sku", "variant_id", "quantity", "quantity_valid",
    "unit_price", "title",
]

PUSH_JOB = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("internal_sku", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("target_quantity", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("max_attempts", T.LongType()),
    T.StructField("next_attempt_at", T.LongType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("created_batch", T.LongType()),
])

ATTEMPT_RESULT = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

STOCK_EVENT = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("internal_sku", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("target_quantity", T.LongType()),
])
