"""DuckDB statements for :mod:`stockflow.plans.landed`, from the tables alone."""

from __future__ import annotations

from stockflow.plans import catalogue_sql
from stockflow.plans.catalogue_sql import INV_RAW, _norm_select

#: Lines with their place in the order's JSON array, as the files spell them.
_LINES = """
jl AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_partkey, l_quantity) - 1 AS line_pos,
    CASE WHEN l_partkey % 17 = 5 THEN 'X-' || l_partkey WHEN l_linenumber % 3 = 1 THEN ' SKU-' || l_partkey || ' ' ELSE 'SKU-' || l_partkey END AS platform_sku,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(100000 + l_partkey AS VARCHAR) END AS variant_id,
    CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_orderkey % 89 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
    (l_orderkey % 97 = 0 OR l_orderkey % 89 <> 0) AS quantity_valid,
    (l_partkey % 100) || '.50' AS unit_price, 'line ' || l_linenumber AS title
  FROM lineitem)"""

_SHOPIFY = f"""{_LINES},
sl AS (
  SELECT * FROM jl
  UNION ALL
  SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) + b, NULL, NULL, 0, true, NULL, NULL
  FROM orders, (SELECT unnest([0, 1]) AS b) WHERE o_orderkey % 19 = 0),
sd AS (
  SELECT o_orderkey AS o, delivery, o_orderkey % 103 = 0 AS cut, o_orderkey % 103 <> 0 AND o_orderkey % 101 <> 0 AS named,
    CAST(o_orderkey AS VARCHAR) AS oid,
    CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN delivery = 2 THEN '#' || o_orderkey || ' again' WHEN o_orderkey % 7 <> 3 THEN '#' || o_orderkey END AS order_name,
    CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'fulfillment-' || o_orderstatus END AS order_status
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [1, 2] ELSE [1] END) AS delivery FROM orders) WHERE o_orderkey % 3 <> 0)"""

_ETSY = """
ed AS (
  SELECT o_orderkey AS o, delivery, o_orderkey % 101 <> 0 AS named, CAST(o_orderkey AS VARCHAR) AS oid, o_orderpriority AS order_status,
    CASE WHEN delivery = 2 THEN 'again' WHEN o_orderkey % 4 = 1 THEN 'Receipt ' || o_orderkey WHEN o_orderkey % 101 <> 0 THEN 'etsy-' || o_orderkey END AS order_name
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [1, 2] ELSE [1] END) AS delivery FROM orders) WHERE o_orderkey % 3 = 0)"""

_STATUS = "CASE WHEN NOT named THEN 'quarantined' WHEN delivery = 1 THEN 'processed' ELSE 'duplicate' END AS status"

#: Webhook deliveries: shopify orders whose signature covers the body; those that are documents.
_HOOKS = """
hd AS (
  SELECT *, o % 13 <> 0 AND o % 11 <> 0 AND o % 17 <> 0 AS signed FROM sd)"""

SQL: dict[str, str] = {
    "orders_json_shopify": f"""
        WITH {_SHOPIFY}
        SELECT 'shopify' AS platform, CASE WHEN named THEN 'shopify-order-' || oid END AS external_event_id, CASE WHEN named THEN oid END AS external_order_id,
               order_name, order_status, CASE WHEN NOT cut THEN 'Shopify order ' || coalesce(order_name, CASE WHEN named THEN oid END) END AS note, {_STATUS},
               line_pos, platform_sku, variant_id, quantity, quantity_valid, unit_price, title
        FROM sd LEFT JOIN sl ON sl.o = sd.o AND NOT cut""",
    "orders_json_etsy_pages": f"""
        WITH {_LINES},{_ETSY}
        SELECT 'etsy' AS platform, CASE WHEN named THEN 'etsy-receipt-' || oid END AS external_event_id, CASE WHEN named THEN oid END AS external_order_id,
               order_name, order_status, CASE WHEN named THEN 'Etsy receipt ' || oid END AS note, {_STATUS},
               line_pos, platform_sku, CAST(NULL AS VARCHAR) AS variant_id, quantity, quantity_valid, unit_price, title
        FROM ed LEFT JOIN jl ON jl.o = ed.o""",
    "csv_import": f"""
        WITH {INV_RAW},
        inv AS ({_norm_select('inv_raw')}),
        v AS (
            SELECT internal_sku, 0 AS t, available_units AS units, CAST(NULL AS BIGINT) AS old, true AS first FROM inv
            UNION ALL
            SELECT i.internal_sku, 1, CAST(r.p_size AS BIGINT) * 10 + 5, i.available_units, false FROM inv_raw r JOIN inv i USING (_row) WHERE _row % 6 = 1
            UNION ALL
            SELECT internal_sku, 2, CASE WHEN _row % 18 <> 1 THEN CAST(p_size AS BIGINT) * 10 END, CAST(p_size AS BIGINT) * 10 + 5, false FROM inv_raw WHERE _row % 6 = 1)
        SELECT internal_sku, 'import_snapshot' AS reason, units - coalesce(old, 0) AS change_units, old AS before_units, units AS after_units,
               CASE WHEN first THEN 'initial import' ELSE 'import changed units' END AS notes
        FROM v WHERE units IS NOT NULL AND units IS DISTINCT FROM old""",
    "webhook_to_ledger": f"""
        WITH {INV_RAW},
        inv AS ({_norm_select('inv_raw')}),{_SHOPIFY},{_ETSY},{_HOOKS},
        dim_variant AS (SELECT shopify_variant_id AS k, min(internal_sku) AS s FROM inv WHERE shopify_variant_id IS NOT NULL GROUP BY 1),
        dim_shop AS (SELECT shopify_sku AS k, min(internal_sku) AS s FROM inv WHERE shopify_sku IS NOT NULL GROUP BY 1),
        dim_etsy AS (SELECT etsy_sku AS k, min(internal_sku) AS s FROM inv WHERE etsy_sku IS NOT NULL GROUP BY 1),
        sold AS (
            SELECT 'shopify' AS platform, hd.o, oid, line_pos, quantity, 'Shopify order ' || coalesce(order_name, oid) AS note, coalesce(v.s, sh.s) AS internal_sku
            FROM hd JOIN sl ON sl.o = hd.o LEFT JOIN dim_variant v ON variant_id = v.k LEFT JOIN dim_shop sh ON nullif(trim(platform_sku), '') = sh.k
            WHERE signed AND named AND delivery = 1 AND quantity_valid AND quantity > 0
            UNION ALL
            SELECT 'etsy', ed.o, oid, line_pos, quantity, 'Etsy receipt ' || oid, e.s
            FROM ed JOIN jl ON jl.o = ed.o LEFT JOIN dim_etsy e ON nullif(trim(platform_sku), '') = e.k
            WHERE named AND delivery = 1 AND quantity_valid AND quantity > 0),
        run AS (
            SELECT s.*, i.available_units AS base,
                   CAST(sum(quantity) OVER (PARTITION BY s.internal_sku ORDER BY s.platform, o, line_pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
            FROM sold s JOIN inv i ON s.internal_sku = i.internal_sku AND i.available_units IS NOT NULL),
        led AS (SELECT *, greatest(0, base - cum + quantity) AS b, greatest(0, base - cum) AS a FROM run)
        SELECT internal_sku, 'import_snapshot' AS reason, CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS external_order_id,
               available_units AS change_units, CAST(NULL AS BIGINT) AS before_units, available_units AS after_units, 'initial import' AS notes
        FROM inv WHERE available_units IS NOT NULL
        UNION ALL
        SELECT internal_sku, 'sale', platform, oid, a - b, b, a,
               note || CASE WHEN b - quantity < 0 THEN ' [oversell: requested ' || quantity || ', only ' || b || ' available]' ELSE '' END
        FROM led""",
    "live_outcomes": f"""
        WITH {_SHOPIFY},{_ETSY},{_HOOKS},
        d AS (
            SELECT 'shopify' AS platform, o, delivery, CASE WHEN NOT signed THEN 'rejected' WHEN NOT named THEN 'malformed' WHEN delivery = 1 THEN 'processed' ELSE 'duplicate' END AS outcome FROM hd
            UNION ALL SELECT 'etsy', o, delivery, {_STATUS.removesuffix(' AS status')} FROM ed),
        n AS (SELECT 'shopify' AS platform, o, count(*) AS lines FROM sl GROUP BY o UNION ALL SELECT 'etsy', o, count(*) FROM jl GROUP BY o)
        SELECT platform, outcome, count(*) AS n FROM d GROUP BY 1, 2
        UNION ALL SELECT platform, 'stored', count(*) FROM d WHERE outcome = 'processed' GROUP BY 1
        UNION ALL SELECT platform, 'stored_lines', CAST(coalesce(sum(lines), 0) AS BIGINT) FROM d LEFT JOIN n USING (platform, o) WHERE outcome = 'processed' GROUP BY 1""",
}
SQL["stream_keyed_ledger"] = catalogue_sql.SQL["ledger_with_imports"]
