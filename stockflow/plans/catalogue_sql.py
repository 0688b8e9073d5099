"""DuckDB oracle SQL for the query catalogue.

Written independently of the Spark operators: the ledger here uses the
segment formulation (``seg = running count of imports``, ``first_value`` of
the segment's import, ``lag`` for an import's old value) while the Spark
side uses two associative scans. Tables ``part orders lineitem`` are views.
"""

from __future__ import annotations

from stockflow.functions.hmac import _pads
from stockflow.sources import testdata as TD

ORD = "ts NULLS FIRST, kind, doc_pos NULLS FIRST, line_pos NULLS FIRST, tie1 NULLS FIRST, tie2 NULLS FIRST"
ORD_DESC = "ts DESC NULLS LAST, kind DESC, doc_pos DESC NULLS LAST, line_pos DESC NULLS LAST, tie1 DESC NULLS LAST, tie2 DESC NULLS LAST"

_NUM_RE = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _tier(x: str) -> str:
    v = f"lower(trim(coalesce({x}, '')))"
    return f"(CASE WHEN {v} IN ('tier1','tier2','tier3') THEN {v} ELSE 'tier3' END)"


def _flag(x: str, default: int) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN {default} "
            f"WHEN lower(trim({x})) IN ('1','true','yes','y') THEN 1 ELSE 0 END)")


def _int(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN trim({x}) = '' THEN 0 "
            f"WHEN regexp_matches({x}, {_NUM_RE}) THEN CAST(trunc(CAST({x} AS DOUBLE)) AS BIGINT) END)")


def _blank(x: str) -> str:
    return f"nullif({x}, '')"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


INV_RAW = f"""
inv_raw AS (
  SELECT p_partkey AS _row, p_size,
    'SKU-' || {_s('p_partkey')} AS internal_sku,
    p_name AS product_name,
    CASE WHEN p_partkey % 29 = 7 THEN 'platinum'
         WHEN p_partkey % 5 = 0 THEN ' ' || upper('tier' || {_s('p_partkey % 3 + 1')}) || ' '
         ELSE 'tier' || {_s('p_partkey % 3 + 1')} END AS tier,
    CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 3 THEN
           (CASE WHEN p_partkey % 4 = 0 THEN 'yes' WHEN p_partkey % 4 = 1 THEN ' 1' ELSE 'True' END)
         WHEN p_partkey % 7 = 0 THEN '' ELSE 'no' END AS sync_enabled,
    CASE WHEN p_partkey % 11 = 0 THEN '0' WHEN p_partkey % 13 = 5 THEN '' ELSE 'y' END AS monitoring_enabled,
    CASE WHEN p_partkey % 9 = 2 THEN ''
         WHEN p_partkey % 41 = 4 THEN 'n/a'
         WHEN p_partkey % 37 = 3 THEN {_s('CAST(p_size AS BIGINT) * 40')} || '.7'
         ELSE {_s('CAST(p_size AS BIGINT) * 40')} END AS available_units,
    CASE WHEN p_partkey % 19 = 0 THEN '' ELSE {_s('10 + p_partkey % 50')} END AS low_stock_threshold,
    CASE WHEN p_partkey % 4 = 1 THEN '6' ELSE '' END AS units_per_pack,
    CASE WHEN p_partkey % 8 = 0 THEN 'fragile' ELSE '' END AS notes,
    CASE WHEN p_partkey % 10 = 9 THEN ''
         WHEN p_partkey % 25 = 24 THEN 'SKU-' || {_s('p_partkey - 1')}
         ELSE 'SKU-' || {_s('p_partkey')} END AS shopify_sku,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {_s('100000 + p_partkey')} END AS shopify_variant_id,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE {_s('200000 + p_partkey')} END AS shopify_inventory_item_id,
    CASE WHEN p_partkey % 13 = 1 THEN '' ELSE '1' END AS shopify_location_id,
    CASE WHEN p_partkey % 7 = 6 THEN '' ELSE 'SKU-' || {_s('p_partkey')} END AS etsy_sku,
    CASE WHEN p_partkey % 13 = 2 THEN '' ELSE {_s('300000 + p_partkey')} END AS etsy_listing_id,
    CASE WHEN p_partkey % 13 = 3 THEN '' ELSE {_s('400000 + p_partkey')} END AS etsy_offering_id
  FROM part)"""


def _norm_select(src: str) -> str:
    return f"""SELECT _row, internal_sku, {_blank('product_name')} AS product_name,
    {_tier('tier')} AS tier, CAST({_flag('sync_enabled', 0)} AS INTEGER) AS sync_enabled,
    CAST({_flag('monitoring_enabled', 1)} AS INTEGER) AS monitoring_enabled,
    {_int('available_units')} AS available_units,
    coalesce({_int('low_stock_threshold')}, CAST(10 AS BIGINT)) AS low_stock_threshold,
    {_int('units_per_pack')} AS units_per_pack, {_blank('notes')} AS notes,
    {_blank('shopify_sku')} AS shopify_sku, {_blank('shopify_variant_id')} AS shopify_variant_id,
    {_blank('shopify_inventory_item_id')} AS shopify_inventory_item_id,
    {_blank('shopify_location_id')} AS shopify_location_id, {_blank('etsy_sku')} AS etsy_sku,
    {_blank('etsy_listing_id')} AS etsy_listing_id, {_blank('etsy_offering_id')} AS etsy_offering_id
  FROM {src}"""


INV = f"""{INV_RAW},
inv AS ({_norm_select('inv_raw')}),
recount_raw AS (
  SELECT * REPLACE (CASE WHEN _row % 18 = 1 THEN '' ELSE {_s('CAST(p_size AS BIGINT) * 10')} END AS available_units)
  FROM inv_raw WHERE _row % 6 = 1),
recount AS ({_norm_select('recount_raw')}),
imports AS (
  SELECT internal_sku, TIMESTAMP '1990-01-01 00:00:00' AS ts, 0 AS kind, CAST(_row AS BIGINT) AS doc_pos,
         CAST(NULL AS BIGINT) AS line_pos, CAST(NULL AS BIGINT) AS tie1, CAST(NULL AS DOUBLE) AS tie2,
         available_units AS units, tier, sync_enabled
  FROM inv
  UNION ALL
  SELECT internal_sku, TIMESTAMP '1998-06-01 00:00:00', 0, CAST(_row AS BIGINT), NULL, NULL, NULL,
         available_units, tier, sync_enabled
  FROM recount),
dim_variant AS (SELECT shopify_variant_id AS k, min(internal_sku) AS s FROM inv
                WHERE shopify_variant_id IS NOT NULL GROUP BY 1),
dim_shop AS (SELECT shopify_sku AS k, min(internal_sku) AS s FROM inv WHERE shopify_sku IS NOT NULL GROUP BY 1),
dim_etsy AS (SELECT etsy_sku AS k, min(internal_sku) AS s FROM inv WHERE etsy_sku IS NOT NULL GROUP BY 1)"""

DOCS_ONLY = f"""
odocs AS (
  SELECT o_orderkey, o_orderdate AS ts,
    CASE WHEN o_orderkey % 3 = 0 THEN 'etsy' ELSE 'shopify' END AS platform,
    {_s('o_orderkey')} AS external_order_id,
    CASE WHEN o_orderkey % 7 <> 3 THEN '#' || {_s('o_orderkey')} END AS shop_name,
    CASE WHEN o_orderkey % 4 = 1 THEN 'Receipt ' || {_s('o_orderkey')} END AS etsy_name,
    o_orderstatus, o_orderpriority
  FROM orders),
docs1 AS (
  SELECT o_orderkey, ts, platform, external_order_id,
    CASE WHEN platform = 'shopify' THEN 'shopify-order-' ELSE 'etsy-receipt-' END || external_order_id
      AS external_event_id,
    CASE WHEN platform = 'shopify' THEN shop_name
         ELSE coalesce(etsy_name, 'etsy-' || external_order_id) END AS order_name,
    CASE WHEN platform = 'shopify' THEN
           (CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'fulfillment-' || o_orderstatus END)
         ELSE o_orderpriority END AS order_status,
    CASE WHEN platform = 'shopify' THEN 'Shopify order ' || coalesce(shop_name, external_order_id)
         ELSE 'Etsy receipt ' || external_order_id END AS note
  FROM odocs),
docs AS (
  SELECT *, 1 AS delivery FROM docs1
  UNION ALL
  SELECT *, 2 AS delivery FROM docs1 WHERE o_orderkey % 5 = 0),
doc_outcome AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY platform, external_event_id
                                          ORDER BY delivery, o_orderkey) = 1
                 THEN 'processed' ELSE 'duplicate' END AS status
  FROM docs)"""

LINES = f"""
lines AS (
  SELECT d.platform, d.external_event_id, d.external_order_id, d.delivery, d.note, d.status AS doc_status,
    d.ts, 1 AS kind, l_orderkey AS doc_pos, CAST(l_linenumber AS BIGINT) AS line_pos,
    l_suppkey AS tie1, l_extendedprice AS tie2,
    CASE WHEN l_partkey % 17 = 5 THEN 'X-' || {_s('l_partkey')}
         WHEN l_linenumber % 3 = 1 THEN ' SKU-' || {_s('l_partkey')} || ' '
         ELSE 'SKU-' || {_s('l_partkey')} END AS platform_sku,
    CASE WHEN d.platform = 'shopify' AND l_linenumber % 2 = 0 THEN {_s('100000 + l_partkey')} END AS variant_id,
    CASE WHEN l_orderkey % 97 = 0 THEN 0.0 WHEN l_orderkey % 89 = 0 THEN 2.5
         ELSE CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) END AS q_d
  FROM lineitem JOIN doc_outcome d ON l_orderkey = d.o_orderkey),
resolved AS (
  SELECT l.*,
    CASE WHEN q_d = floor(q_d) THEN CAST(q_d AS BIGINT) END AS quantity,
    (q_d = floor(q_d)) AS quantity_valid,
    CASE WHEN l.platform = 'shopify' THEN coalesce(v.s, sh.s) ELSE e.s END AS internal_sku
  FROM lines l
  LEFT JOIN dim_variant v ON l.platform = 'shopify' AND l.variant_id = v.k
  LEFT JOIN dim_shop sh ON l.platform = 'shopify' AND nullif(trim(l.platform_sku), '') = sh.k
  LEFT JOIN dim_etsy e ON l.platform = 'etsy' AND nullif(trim(l.platform_sku), '') = e.k),
won AS (
  SELECT *, (internal_sku IS NOT NULL AND quantity_valid AND quantity > 0) AS line_valid
  FROM resolved WHERE doc_status = 'processed')"""

DOCS = DOCS_ONLY + "," + LINES

LEDGER = f"""
changes AS (
  SELECT internal_sku, ts, kind, doc_pos, line_pos, tie1, tie2, units, tier, sync_enabled,
         CAST(NULL AS BIGINT) AS quantity, CAST(NULL AS VARCHAR) AS platform,
         CAST(NULL AS VARCHAR) AS external_order_id, CAST(NULL AS VARCHAR) AS note
  FROM imports
  UNION ALL
  SELECT internal_sku, ts, kind, doc_pos, line_pos, tie1, tie2, NULL, NULL, NULL,
         quantity, platform, external_order_id, note
  FROM won WHERE line_valid),
seg AS (
  SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY internal_sku ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS seg,
            row_number() OVER (PARTITION BY internal_sku ORDER BY {ORD}) AS rn
  FROM changes),
seg2 AS (
  SELECT *,
    first_value(units) OVER (PARTITION BY internal_sku, seg ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS base,
    first_value(tier) OVER (PARTITION BY internal_sku, seg ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS seg_tier,
    first_value(sync_enabled) OVER (PARTITION BY internal_sku, seg ORDER BY {ORD} ROWS UNBOUNDED PRECEDING)
      AS seg_sync,
    CAST(sum(CASE WHEN kind = 1 THEN quantity ELSE 0 END)
      OVER (PARTITION BY internal_sku, seg ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumq
  FROM seg),
calc AS (
  SELECT *,
    CASE WHEN kind = 1 AND base IS NOT NULL THEN greatest(0, base - cumq + quantity) END AS s_before,
    CASE WHEN kind = 1 AND base IS NOT NULL THEN greatest(0, base - cumq) END AS s_after,
    CASE WHEN kind = 0 THEN units WHEN base IS NOT NULL THEN greatest(0, base - cumq) END AS val
  FROM seg2),
calc2 AS (
  SELECT *, lag(val) OVER (PARTITION BY internal_sku ORDER BY {ORD}) AS prev_val FROM calc),
applied AS (
  SELECT *,
    (kind = 1 AND base IS NOT NULL) AS tracked,
    (kind = 0 AND units IS NOT NULL AND (prev_val IS NULL OR units <> prev_val)) AS writes_import,
    (kind = 1 AND base IS NOT NULL AND s_before - quantity < 0) AS oversold
  FROM calc2),
applied_n AS (
  SELECT *,
    CASE WHEN tracked AND oversold THEN
           (CASE WHEN coalesce(note, '') <> '' THEN note || ' ' ELSE '' END)
           || '[oversell: requested ' || CAST(quantity AS VARCHAR) || ', only ' || CAST(s_before AS VARCHAR)
           || ' available]'
         WHEN tracked THEN nullif(note, '')
         WHEN rn = 1 THEN 'initial import' ELSE 'import changed units' END AS ledger_notes
  FROM applied),
ledger AS (
  SELECT internal_sku, ts, kind, doc_pos, line_pos, tie1, tie2,
    CASE WHEN kind = 1 THEN 'sale' ELSE 'import_snapshot' END AS reason,
    platform, external_order_id,
    CASE WHEN tracked THEN s_after - s_before ELSE units - coalesce(prev_val, 0) END AS change_units,
    CASE WHEN tracked THEN s_before ELSE prev_val END AS before_units,
    CASE WHEN tracked THEN s_after ELSE units END AS after_units,
    ledger_notes AS notes
  FROM applied_n WHERE tracked OR writes_import)"""


def with_ledger(body: str) -> str:
    return f"WITH {INV},{DOCS},{LEDGER}\n{body}"


SQL: dict[str, str] = {}

SQL["inventory_import_normalized"] = f"""WITH {INV_RAW},
inv AS ({_norm_select('inv_raw')})
SELECT * EXCLUDE (_row) FROM inv"""

SQL["sku_resolution"] = f"""WITH {INV},{DOCS}
SELECT platform, external_event_id, CAST(delivery AS BIGINT) AS delivery, strftime(ts, '%Y-%m-%d') AS event_date,
       doc_pos, line_pos, tie1,
       platform_sku, variant_id, internal_sku
FROM resolved"""

SQL["sku_ambiguity"] = f"""WITH {INV_RAW},
inv AS ({_norm_select('inv_raw')}),
k AS (
  SELECT 'shopify_variant_id' AS key_kind, shopify_variant_id AS channel_key, internal_sku FROM inv
  WHERE shopify_variant_id IS NOT NULL
  UNION ALL SELECT 'shopify_sku', shopify_sku, internal_sku FROM inv WHERE shopify_sku IS NOT NULL
  UNION ALL SELECT 'etsy_sku', etsy_sku, internal_sku FROM inv WHERE etsy_sku IS NOT NULL)
SELECT key_kind, channel_key, count(*) AS n_skus, min(internal_sku) AS chosen_sku, max(internal_sku) AS max_sku
FROM k GROUP BY 1, 2 HAVING count(*) > 1"""

SQL["order_dedupe"] = f"""WITH {DOCS_ONLY}
SELECT platform, external_event_id, external_order_id, CAST(delivery AS BIGINT) AS delivery, order_name,
       order_status, status
FROM doc_outcome"""

SQL["duplicate_report"] = f"""WITH {DOCS_ONLY}
SELECT platform, status, count(*) AS n FROM doc_outcome GROUP BY 1, 2"""

SQL["ledger_clamped"] = f"""WITH {INV_RAW},
inv AS ({_norm_select('inv_raw')}),
sales AS (
  SELECT 'SKU-' || {_s('l_partkey')} AS internal_sku, o_orderdate AS ts, l_orderkey AS doc_pos,
         CAST(l_linenumber AS BIGINT) AS line_pos, l_suppkey AS tie1, l_extendedprice AS tie2,
         CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
run AS (
  SELECT s.*, i.available_units AS base,
    CAST(sum(quantity) OVER (PARTITION BY s.internal_sku ORDER BY ts, doc_pos, line_pos, tie1, tie2
                        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumq
  FROM sales s JOIN inv i ON s.internal_sku = i.internal_sku AND i.available_units IS NOT NULL)
SELECT internal_sku, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, quantity,
       greatest(0, base - cumq + quantity) AS before_units, greatest(0, base - cumq) AS after_units,
       greatest(0, base - cumq) - greatest(0, base - cumq + quantity) AS change_units,
       (greatest(0, base - cumq + quantity) - quantity < 0) AS oversold
FROM run"""

SQL["ledger_with_imports"] = with_ledger("""
SELECT internal_sku, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, reason, platform,
       external_order_id, change_units, before_units, after_units, notes
FROM ledger""")

SQL["sale_status"] = with_ledger("""
SELECT platform, external_order_id, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, internal_sku,
  quantity,
  CASE WHEN base IS NULL THEN 'tracked_only'
       WHEN seg_tier = 'tier1' AND seg_sync = 1 THEN 'enqueued'
       WHEN seg_tier = 'tier2' THEN 'tracked_only' ELSE 'manual' END AS status,
  CASE WHEN base IS NULL THEN 'this SKU has no reliable unit-level stock; order recorded but not auto-decremented'
       WHEN seg_tier = 'tier1' AND seg_sync = 1
         THEN 'tier1 SKU: stock decremented, write-back deferred to the worker pipeline'
       WHEN seg_tier = 'tier2' THEN 'tier2 SKU: internal stock/trend recorded, no write-back'
       ELSE 'tier3 SKU: manual workflow kept, no write-back' END AS message
FROM applied WHERE kind = 1
UNION ALL
SELECT platform, external_order_id, strftime(ts, '%Y-%m-%d'), doc_pos, line_pos, tie1, NULL, quantity, 'unresolved',
  'no internal SKU mapping found or invalid quantity'
FROM won WHERE NOT line_valid""")

SQL["oversell_notes"] = with_ledger("""
SELECT internal_sku, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, quantity,
       s_before AS before_units, ledger_notes AS notes
FROM applied_n WHERE oversold""")

SQL["stock_after"] = with_ledger(f"""
SELECT internal_sku, val AS available_units FROM (
  SELECT internal_sku, val, row_number() OVER (PARTITION BY internal_sku ORDER BY {ORD_DESC}) AS r
  FROM applied) WHERE r = 1""")


NOW = 1_700_000_000_000
MOCK = TD.REFUSED

OUTBOX = f"""
owed AS (
  SELECT internal_sku, s_after AS target_quantity FROM (
    SELECT internal_sku, s_after, row_number() OVER (PARTITION BY internal_sku ORDER BY {ORD_DESC}) AS r
    FROM applied WHERE tracked AND seg_tier = 'tier1' AND seg_sync = 1) t WHERE r = 1),
jobs0 AS (
  SELECT o.internal_sku, p.platform, CAST(o.target_quantity AS BIGINT) AS target_quantity,
         'pending' AS status, CAST(0 AS BIGINT) AS attempts, CAST(5 AS BIGINT) AS max_attempts,
         CAST({NOW} AS BIGINT) AS next_attempt_at, CAST(NULL AS VARCHAR) AS last_error
  FROM owed o CROSS JOIN (VALUES ('shopify'), ('etsy')) p(platform)),
omap AS (SELECT * FROM inv WHERE _row % 13 <> 4),
routed AS (
  SELECT j.*,
    CASE WHEN m.internal_sku IS NULL THEN 'no SKU mapping found'
         WHEN j.platform = 'shopify' AND NOT (coalesce(m.shopify_inventory_item_id, '') <> ''
              AND coalesce(m.shopify_location_id, '') <> '') THEN 'missing Shopify inventory mapping'
         WHEN j.platform = 'etsy' AND NOT (coalesce(m.etsy_listing_id, '') <> ''
              AND coalesce(m.etsy_offering_id, '') <> '') THEN 'missing Etsy mapping / offering id'
    END AS skip_reason,
    CASE WHEN j.platform = 'shopify' THEN m.shopify_inventory_item_id ELSE m.etsy_listing_id END AS route_id,
    CASE WHEN j.platform = 'shopify' THEN nullif(m.shopify_location_id, '') ELSE m.etsy_offering_id END
      AS route_sub_id,
    (CAST(substr(j.internal_sku, 5) AS BIGINT) // 3) * 2 + CASE WHEN j.platform = 'etsy' THEN 1 ELSE 0 END AS jk
  FROM jobs0 j LEFT JOIN omap m ON j.internal_sku = m.internal_sku),
att AS (
  SELECT r.*, k.attempt_no, (r.skip_reason IS NULL AND (r.jk + k.attempt_no) % 6 = 0) AS ok
  FROM routed r CROSS JOIN (SELECT range AS attempt_no FROM range(1, 6)) k),
term AS (
  SELECT *, coalesce(min(CASE WHEN ok OR skip_reason IS NOT NULL THEN attempt_no END)
                     OVER (PARTITION BY internal_sku, platform), max_attempts) AS terminal
  FROM att),
hist AS (
  SELECT internal_sku, platform, target_quantity, max_attempts, skip_reason,
    CAST(attempt_no AS BIGINT) AS attempt_no,
    CAST(next_attempt_at + 5000 * ((CAST(1 AS BIGINT) << CAST(attempt_no - 1 AS INTEGER)) - 1) AS BIGINT)
      AS attempt_at,
    CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN ok THEN 'succeeded'
         WHEN attempt_no >= max_attempts THEN 'dead_letter' ELSE 'retry_scheduled' END AS outcome,
    CASE WHEN skip_reason IS NOT NULL THEN skip_reason
         WHEN ok THEN platform || ' inventory updated (attempt ' || CAST(attempt_no AS VARCHAR) || ')'
         WHEN attempt_no >= max_attempts
           THEN 'dead-lettered after ' || CAST(attempt_no AS VARCHAR) || ' attempts: {MOCK}'
         ELSE 'attempt ' || CAST(attempt_no AS VARCHAR) || ' failed, retry in '
              || CAST(5000 * (CAST(1 AS BIGINT) << CAST(attempt_no - 1 AS INTEGER)) AS VARCHAR) || 'ms: {MOCK}'
    END AS message
  FROM term WHERE attempt_no <= terminal),
round1 AS (
  SELECT internal_sku, platform, target_quantity,
    CASE outcome WHEN 'retry_scheduled' THEN 'pending' ELSE outcome END AS status,
    attempt_no AS attempts, max_attempts,
    CAST(CASE WHEN outcome = 'retry_scheduled' THEN {NOW} + 5000 ELSE {NOW} END AS BIGINT) AS next_attempt_at,
    CASE WHEN outcome = 'succeeded' THEN NULL WHEN outcome = 'skipped' THEN message ELSE '{MOCK}' END
      AS last_error,
    outcome,
    CASE outcome WHEN 'skipped' THEN 'skipped' WHEN 'succeeded' THEN 'success' ELSE 'failed' END AS log_status,
    message
  FROM hist WHERE attempt_no = 1),
terminal_jobs AS (
  SELECT internal_sku, platform, target_quantity,
    CASE outcome WHEN 'retry_scheduled' THEN 'pending' ELSE outcome END AS status,
    attempt_no AS attempts, max_attempts, attempt_at AS next_attempt_at,
    CASE WHEN outcome = 'succeeded' THEN NULL WHEN outcome = 'skipped' THEN message ELSE '{MOCK}' END
      AS last_error
  FROM (SELECT *, row_number() OVER (PARTITION BY internal_sku, platform ORDER BY attempt_no DESC) AS r
        FROM hist) t WHERE r = 1)"""


def with_outbox(body: str) -> str:
    return f"WITH {INV},{DOCS},{LEDGER},{OUTBOX}\n{body}"


JOB_VIEW = "internal_sku, platform, target_quantity, status, attempts, max_attempts, next_attempt_at, last_error"

SQL["outbox_coalesced"] = with_outbox(f"SELECT {JOB_VIEW} FROM jobs0")
SQL["push_skip_reason"] = with_outbox(
    "SELECT internal_sku, platform, skip_reason, route_id, route_sub_id FROM routed")
SQL["push_transition"] = with_outbox(f"SELECT {JOB_VIEW}, outcome, log_status, message FROM round1")
SQL["outcome_counts"] = with_outbox("SELECT outcome, count(*) AS n FROM round1 GROUP BY 1")
SQL["due_jobs_topk"] = with_outbox(f"""
SELECT internal_sku, platform, next_attempt_at, attempts, target_quantity FROM round1
WHERE status = 'pending' AND next_attempt_at <= {NOW} + 5000
ORDER BY next_attempt_at, internal_sku, platform LIMIT 50""")
SQL["job_claim"] = with_outbox(f"""
SELECT internal_sku, platform, status, attempts, CAST(next_attempt_at + 30000 AS BIGINT) AS next_attempt_at
FROM round1 WHERE status = 'pending' AND next_attempt_at <= {NOW} + 5000""")
SQL["push_attempt_history"] = with_outbox(
    "SELECT internal_sku, platform, attempt_no, attempt_at, outcome, message FROM hist")
SQL["requeue"] = with_outbox(f"""
SELECT internal_sku, platform, target_quantity,
  CASE WHEN hit THEN 'pending' ELSE status END AS status,
  CASE WHEN hit THEN CAST(0 AS BIGINT) ELSE attempts END AS attempts, max_attempts,
  CASE WHEN hit THEN CAST({NOW} + 3600000 AS BIGINT) ELSE next_attempt_at END AS next_attempt_at,
  CASE WHEN hit THEN NULL ELSE last_error END AS last_error
FROM (SELECT *, (CAST(substr(internal_sku, 5) AS BIGINT) % 2 = 0 AND status = 'dead_letter') AS hit
      FROM terminal_jobs) t""")
SQL["dead_letters"] = with_outbox(f"SELECT {JOB_VIEW} FROM terminal_jobs WHERE status = 'dead_letter'")
SQL["double_delivery"] = with_outbox("""
SELECT internal_sku, platform, count(*) AS n
FROM (SELECT * FROM hist UNION ALL SELECT * FROM hist) t
WHERE outcome = 'succeeded' GROUP BY 1, 2 HAVING count(*) > 1""")

RECON = f"""
final_stock AS (
  SELECT internal_sku, val AS available_units FROM (
    SELECT internal_sku, val, row_number() OVER (PARTITION BY internal_sku ORDER BY {ORD_DESC}) AS r
    FROM applied) t WHERE r = 1),
live AS (
  SELECT internal_sku,
    CASE WHEN CAST(substr(internal_sku, 5) AS BIGINT) % 50 = 0 THEN available_units - 15
         ELSE available_units END AS available_units
  FROM final_stock),
fled AS (
  SELECT internal_sku, ts, kind, doc_pos, line_pos, tie1, tie2, reason,
    change_units + CASE WHEN reason = 'sale' AND doc_pos % 17 = 0 THEN 2 ELSE 0 END AS change_units,
    before_units + CASE WHEN reason = 'sale' AND doc_pos % 23 = 0 THEN 1 ELSE 0 END AS before_units,
    after_units + CASE WHEN reason = 'sale' AND doc_pos % 23 = 0 THEN 1 ELSE 0 END AS after_units
  FROM ledger WHERE internal_sku IN (SELECT internal_sku FROM live)),
broken AS (
  SELECT internal_sku, ts, doc_pos, line_pos, tie1, 'broken_row' AS type,
    'before(' || coalesce(CAST(before_units AS VARCHAR), 'null') || ') + change('
    || CAST(change_units AS VARCHAR) || ') != after(' || coalesce(CAST(after_units AS VARCHAR), 'null') || ')'
      AS detail
  FROM fled WHERE (coalesce(before_units, 0) + change_units) IS DISTINCT FROM after_units),
gaps AS (
  SELECT internal_sku, ts, doc_pos, line_pos, tie1, 'chain_gap' AS type,
    'row starts at ' || CAST(before_units AS VARCHAR) || ' but previous row ended at '
    || CAST(prev_after AS VARCHAR) AS detail
  FROM (SELECT *, lag(after_units) OVER (PARTITION BY internal_sku ORDER BY {ORD}) AS prev_after FROM fled) t
  WHERE before_units IS NOT NULL AND prev_after IS NOT NULL AND before_units <> prev_after),
expected AS (
  SELECT internal_sku, after_units AS expected_units FROM (
    SELECT *, row_number() OVER (PARTITION BY internal_sku ORDER BY {ORD_DESC}) AS r FROM fled) t
  WHERE r = 1),
drift AS (
  SELECT e.internal_sku, e.expected_units, l.available_units AS actual_units,
         coalesce(l.available_units, 0) - e.expected_units AS delta
  FROM expected e JOIN live l ON e.internal_sku = l.internal_sku
  WHERE e.expected_units IS NOT NULL AND l.available_units IS DISTINCT FROM e.expected_units)"""


def with_recon(body: str) -> str:
    return f"WITH {INV},{DOCS},{LEDGER},{RECON}\n{body}"


SQL["reconcile_broken_rows"] = with_recon(
    "SELECT internal_sku, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, type, detail FROM broken")
SQL["reconcile_chain_gaps"] = with_recon(
    "SELECT internal_sku, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, type, detail FROM gaps")
SQL["reconcile_drift"] = with_recon("SELECT * FROM drift")
SQL["reconcile_summary"] = with_recon("""
SELECT checked_skus, mismatch_count, chain_violation_count,
  (mismatch_count = 0 AND chain_violation_count = 0) AS consistent,
  CASE WHEN mismatch_count + chain_violation_count > 0 THEN 'drift' ELSE 'clean' END AS label
FROM (SELECT (SELECT count(DISTINCT internal_sku) FROM fled) AS checked_skus,
             (SELECT count(*) FROM drift) AS mismatch_count,
             (SELECT count(*) FROM broken) + (SELECT count(*) FROM gaps) AS chain_violation_count) t""")


REPORTS = """
fitems AS (
  SELECT i.internal_sku, i.product_name, i.tier, i.sync_enabled, i.monitoring_enabled,
         f.available_units, i.low_stock_threshold, i.units_per_pack, i.notes, i.shopify_sku, i.etsy_sku
  FROM inv i JOIN final_stock f ON i.internal_sku = f.internal_sku),
lowstock AS (
  SELECT * FROM fitems WHERE monitoring_enabled = 1 AND available_units IS NOT NULL
    AND low_stock_threshold IS NOT NULL AND available_units <= low_stock_threshold)"""


def with_reports(body: str) -> str:
    return f"WITH {INV},{DOCS},{LEDGER},{OUTBOX},{RECON},{REPORTS}\n{body}"


ITEM_VIEW = ("internal_sku, product_name, tier, sync_enabled, monitoring_enabled, available_units, "
             "low_stock_threshold, units_per_pack, notes")
SQL["inventory_snapshot"] = with_reports(f"SELECT {ITEM_VIEW}, shopify_sku, etsy_sku FROM fitems")
SQL["low_stock"] = with_reports("SELECT internal_sku, available_units, low_stock_threshold FROM lowstock")
SQL["low_stock_flag"] = with_reports("""
SELECT internal_sku, available_units, internal_sku IN (SELECT internal_sku FROM lowstock) AS is_low_stock
FROM fitems""")
SQL["kpis"] = with_reports("""
SELECT (SELECT count(*) FROM fitems) AS sku_count,
       (SELECT CAST(coalesce(sum(coalesce(available_units, 0)), 0) AS BIGINT) FROM fitems) AS units_on_hand,
       (SELECT count(*) FROM lowstock) AS low_stock_count,
       (SELECT count(*) FROM terminal_jobs WHERE status = 'pending') AS pending_jobs,
       (SELECT count(*) FROM terminal_jobs WHERE status = 'dead_letter') AS dead_letter_jobs,
       CASE WHEN (SELECT count(*) FROM drift) + (SELECT count(*) FROM broken) + (SELECT count(*) FROM gaps) > 0
            THEN 'drift' ELSE 'clean' END AS last_run_label""")
SQL["recent_ledger"] = with_reports(f"""
SELECT internal_sku, strftime(ts, '%Y-%m-%d') AS event_date, doc_pos, line_pos, tie1, reason, change_units,
       before_units, after_units
FROM ledger ORDER BY {ORD_DESC}, internal_sku DESC LIMIT 50""")
SQL["percentiles_nearest_rank"] = with_reports("""
SELECT platform, n,
  max(CASE WHEN idx = least(n - 1, CAST(floor(50 / 100.0 * n) AS BIGINT)) THEN units END) AS p50,
  max(CASE WHEN idx = least(n - 1, CAST(floor(95 / 100.0 * n) AS BIGINT)) THEN units END) AS p95,
  max(CASE WHEN idx = least(n - 1, CAST(floor(99 / 100.0 * n) AS BIGINT)) THEN units END) AS p99
FROM (SELECT platform, units, row_number() OVER (PARTITION BY platform ORDER BY units) - 1 AS idx,
             count(*) OVER (PARTITION BY platform) AS n
      FROM (SELECT platform, external_event_id, CAST(sum(quantity) AS BIGINT) AS units
            FROM won WHERE line_valid GROUP BY 1, 2) po) r
GROUP BY platform, n""")
SQL["throughput"] = with_reports("""
SELECT platform, n, seconds, CASE WHEN seconds > 0 THEN round(n / seconds, 6) END AS rows_per_second
FROM (SELECT platform, count(*) AS n, date_diff('second', min(ts), max(ts)) AS seconds
      FROM applied WHERE kind = 1 GROUP BY platform) t""")
SQL["orphan_checks"] = with_reports("""
SELECT 'mapping_without_item' AS "check", count(*) AS n FROM inv WHERE internal_sku NOT IN (SELECT internal_sku FROM fitems)
UNION ALL SELECT 'ledger_without_item', count(*) FROM ledger WHERE internal_sku NOT IN (SELECT internal_sku FROM fitems)
UNION ALL SELECT 'line_without_event', count(*) FROM won
  WHERE (platform, external_event_id) NOT IN (SELECT (platform, external_event_id) FROM doc_outcome WHERE status = 'processed')""")
SQL["order_results_nested"] = with_reports("""
SELECT d.platform, d.external_order_id, 'processed' AS status, coalesce(r.n_lines, 0) AS n_lines,
       coalesce(r.items_json, '[]') AS items_json
FROM doc_outcome d LEFT JOIN (
  SELECT platform, external_order_id, count(*) AS n_lines,
    CAST(to_json(list({'line_pos': line_pos, 'tie1': tie1, 'internal_sku': internal_sku, 'quantity': quantity,
                        'status': status}
                 ORDER BY line_pos NULLS FIRST, tie1 NULLS FIRST, internal_sku NULLS FIRST,
                          quantity NULLS FIRST, status NULLS FIRST)) AS VARCHAR) AS items_json
  FROM (SELECT platform, external_order_id, line_pos, tie1, internal_sku, quantity,
          CASE WHEN base IS NULL THEN 'tracked_only' WHEN seg_tier = 'tier1' AND seg_sync = 1 THEN 'enqueued'
               WHEN seg_tier = 'tier2' THEN 'tracked_only' ELSE 'manual' END AS status
        FROM applied WHERE kind = 1
        UNION ALL
        SELECT platform, external_order_id, line_pos, tie1, NULL, quantity, 'unresolved'
        FROM won WHERE NOT line_valid) x
  GROUP BY 1, 2) r ON d.platform = r.platform AND d.external_order_id = r.external_order_id
WHERE d.status = 'processed'""")
SQL["order_results"] = with_ledger("""
, line AS (
  SELECT platform, external_order_id, ts, doc_pos, line_pos, tie1, tie2,
    CASE WHEN s_before IS NULL
      THEN to_json({'internalSku': internal_sku, 'quantity': quantity, 'status': 'tracked_only',
                    'message': 'this SKU has no reliable unit-level stock; order recorded but not auto-decremented'})
      ELSE to_json({'internalSku': internal_sku, 'quantity': quantity,
        'status': CASE WHEN seg_tier = 'tier1' AND seg_sync = 1 THEN 'enqueued' WHEN seg_tier = 'tier2' THEN 'tracked_only' ELSE 'manual' END,
        'message': CASE WHEN seg_tier = 'tier1' AND seg_sync = 1 THEN 'tier1 SKU: stock decremented, write-back deferred to the worker pipeline'
                        WHEN seg_tier = 'tier2' THEN 'tier2 SKU: internal stock/trend recorded, no write-back'
                        ELSE 'tier3 SKU: manual workflow kept, no write-back' END,
        'beforeUnits': s_before, 'afterUnits': s_after, 'oversold': oversold}) END AS item
  FROM applied WHERE kind = 1
  UNION ALL
  SELECT platform, external_order_id, ts, doc_pos, line_pos, tie1, tie2,
    to_json({'platformSku': platform_sku, 'status': 'unresolved', 'message': 'no internal SKU mapping found or invalid quantity'})
  FROM won WHERE NOT line_valid)
SELECT d.platform, d.external_order_id, CAST(d.delivery AS BIGINT) AS delivery, d.status,
  '{"platform":"' || d.platform || '","orderId":"' || d.external_order_id || '","status":"' || d.status || '"'
  || CASE WHEN d.status = 'processed' THEN ',"items":[' || coalesce(r.items, '') || ']' ELSE '' END || '}' AS result
FROM doc_outcome d LEFT JOIN (
  SELECT platform, external_order_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY ts, doc_pos, line_pos, tie1, tie2) AS items
  FROM line GROUP BY 1, 2) r ON d.platform = r.platform AND d.external_order_id = r.external_order_id""")


def _hmac(secret: str, body: str) -> str:
    """HMAC-SHA256 in base 64 of a text column, by its definition."""
    ipad, opad = _pads(secret)
    return f"to_base64(unhex(sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({body}))))))"


SQL["webhook_verify"] = f"""
WITH p AS (
  SELECT 'shopify-order-' || CAST(o_orderkey AS VARCHAR) AS external_event_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'wrong_secret'
         WHEN o_orderkey % 17 = 0 THEN 'tampered' ELSE 'valid' END AS "case",
    '{{"id":' || CAST(o_orderkey AS VARCHAR) || ',"name":"#' || CAST(o_orderkey AS VARCHAR) || '"}}' AS body,
    '{{"id":' || CAST(o_orderkey AS VARCHAR) || ',"name":"#' || CAST(o_orderkey AS VARCHAR) || '!"}}' AS tampered
  FROM orders),
s AS (
  SELECT *,
    CASE WHEN "case" = 'missing' THEN NULL
         WHEN "case" = 'wrong_secret' THEN {_hmac(TD.WRONG_SECRET, "body")}
         ELSE {_hmac(TD.WEBHOOK_SECRET, "body")} END AS signature,
    CASE WHEN "case" = 'tampered' THEN tampered ELSE body END AS delivered
  FROM p)
SELECT external_event_id, "case",
  coalesce(signature IS NOT NULL AND signature <> ''
           AND signature = {_hmac(TD.WEBHOOK_SECRET, "delivered")},
           false) AS accepted
FROM s"""
SQL["stock_events_json"] = with_outbox(f"""
SELECT internal_sku AS key, internal_sku, platform, target_quantity FROM round1
WHERE status = 'pending' AND next_attempt_at <= {NOW} + 5000""")

SQL["stream_ingest"] = SQL["ledger_with_imports"]
SQL["stream_relay_consume"] = with_outbox(f"""
SELECT internal_sku, platform, status, attempts,
  CAST(CASE WHEN outcome = 'retry_scheduled' THEN {NOW} + 5000 ELSE {NOW} + 30000 END AS BIGINT) AS next_attempt_at,
  last_error, outcome
FROM round1""")
SQL["stream_audit"] = with_outbox("SELECT internal_sku AS key, platform, target_quantity FROM jobs0")

SQL["attempt_log_numbered"] = """
WITH e AS (
  SELECT *, event_type <> 'signup' AS attempt, event_type = 'purchase' AS ok, event_type = 'click' AND event_id % 10 = 0 AS skipped,
    CASE WHEN user_id % 2 = 0 THEN 'shopify' ELSE 'etsy' END AS platform,
    CAST(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
  FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS attempt_no FROM e WHERE attempt),
t AS (SELECT *, (skipped OR ok OR attempt_no >= 5) AS ends FROM n)
SELECT user_id AS job_id, event_id, epoch, attempt_no,
  CASE WHEN skipped THEN 'skipped' WHEN ok THEN 'succeeded' WHEN attempt_no >= 5 THEN 'dead_letter' ELSE 'retry_scheduled' END AS outcome,
  CASE WHEN skipped THEN 'no route'
       WHEN ok THEN platform || ' inventory updated (attempt ' || attempt_no || ')'
       WHEN attempt_no >= 5 THEN 'dead-lettered after ' || attempt_no || ' attempts: refused: ' || event_type
       ELSE 'attempt ' || attempt_no || ' failed, retry in ' || (5000 * (1::BIGINT << (attempt_no - 1)::INT)) || 'ms: refused: ' || event_type END AS message,
  coalesce(sum(ends::INT) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS superfluous
FROM t"""

SQL["exactly_once_audit"] = with_reports("""
SELECT deliveries, distinct_events, processed, duplicates, sale_rows, stock_mismatch,
       (processed = distinct_events AND stock_mismatch = 0) AS exactly_once
FROM (SELECT
  (SELECT count(*) FROM doc_outcome) AS deliveries,
  (SELECT count(*) FROM (SELECT DISTINCT platform, external_event_id FROM doc_outcome) t) AS distinct_events,
  (SELECT count(*) FROM doc_outcome WHERE status = 'processed') AS processed,
  (SELECT count(*) FROM doc_outcome WHERE status = 'duplicate') AS duplicates,
  (SELECT count(*) FROM ledger WHERE reason = 'sale') AS sale_rows,
  (SELECT count(*) FROM (
     SELECT i.internal_sku, CASE WHEN any_value(i.units) IS NOT NULL THEN greatest(0, any_value(i.units) - coalesce(sum(w.quantity), 0)) END AS proven
     FROM (SELECT * FROM imports QUALIFY row_number() OVER (PARTITION BY internal_sku ORDER BY ts DESC) = 1) i
     LEFT JOIN won w ON w.internal_sku = i.internal_sku AND w.line_valid AND w.ts >= i.ts GROUP BY i.internal_sku) p
   FULL JOIN final_stock f ON p.internal_sku = f.internal_sku
   WHERE p.proven IS DISTINCT FROM f.available_units OR p.internal_sku IS NULL OR f.internal_sku IS NULL)
    AS stock_mismatch) x""")
