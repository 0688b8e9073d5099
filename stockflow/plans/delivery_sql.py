"""DuckDB statements for :mod:`stockflow.plans.delivery`."""

from __future__ import annotations

from stockflow.plans.catalogue_sql import DOCS, INV, MOCK, NOW, with_outbox

REQUEUED = f""", two AS (
  SELECT *, coalesce(min(CASE WHEN ok OR skip_reason IS NOT NULL THEN attempt_no END) OVER (PARTITION BY internal_sku, platform), 2) AS stop
  FROM att WHERE attempt_no <= 2),
first_epoch AS (
  SELECT internal_sku, platform, target_quantity, CAST(0 AS BIGINT) AS epoch, CAST(attempt_no AS BIGINT) AS attempt_no,
    CAST({NOW} + 5000 * (attempt_no - 1) AS BIGINT) AS attempt_at,
    CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN ok THEN 'succeeded' WHEN attempt_no = 2 THEN 'dead_letter' ELSE 'retry_scheduled' END AS outcome,
    CASE WHEN skip_reason IS NOT NULL THEN skip_reason WHEN ok THEN platform || ' inventory updated (attempt ' || attempt_no || ')'
         WHEN attempt_no = 2 THEN 'dead-lettered after 2 attempts: {MOCK}' ELSE 'attempt 1 failed, retry in 5000ms: {MOCK}' END AS message
  FROM two WHERE attempt_no <= stop),
log AS (
  SELECT * FROM first_epoch
  UNION ALL
  SELECT internal_sku, platform, target_quantity, 1, 1, {NOW} + 3600000, 'succeeded', platform || ' inventory updated (attempt 1)'
  FROM first_epoch WHERE outcome = 'dead_letter' AND CAST(substr(internal_sku, 5) AS BIGINT) % 2 = 0)
"""

SQL: dict[str, str] = {
    "relay_release": with_outbox(f"""
SELECT internal_sku, platform, target_quantity, accepted, CAST({NOW} + ms AS BIGINT) AS sent_at,
  CAST({NOW} + ms + CASE WHEN accepted THEN 30000 ELSE 0 END AS BIGINT) AS due_at
FROM (
  SELECT *, 0 AS ms, p % 5 <> 2 AS accepted FROM (SELECT *, CAST(substr(internal_sku, 5) AS BIGINT) AS p FROM jobs0) t
  UNION ALL
  SELECT *, 2000, p % 10 <> 7 FROM (SELECT *, CAST(substr(internal_sku, 5) AS BIGINT) AS p FROM jobs0) t WHERE p % 5 = 2
  UNION ALL
  SELECT *, 30000, true FROM (SELECT *, CAST(substr(internal_sku, 5) AS BIGINT) AS p FROM jobs0) t WHERE p % 5 <> 2 OR p % 10 = 7) r"""),
    "writeback_attempts": with_outbox("""
SELECT h.internal_sku, h.platform, j.target_quantity, attempt_no, attempt_at, outcome, message
FROM hist h JOIN jobs0 j USING (internal_sku, platform) WHERE attempt_no <= 2"""),
    "writeback_requeued": with_outbox(REQUEUED + """
SELECT internal_sku, platform, epoch, attempt_no, attempt_at, outcome, message FROM log"""),
    "writeback_jobs": with_outbox(REQUEUED + f"""
SELECT internal_sku, platform, any_value(target_quantity) AS target_quantity, last(outcome ORDER BY attempt_at) AS status,
  last(attempt_no ORDER BY attempt_at) AS attempts,
  CASE last(outcome ORDER BY attempt_at) WHEN 'skipped' THEN any_value(message) WHEN 'dead_letter' THEN '{MOCK}' END AS last_error,
  count(*) AS n_attempts, count(*) FILTER (outcome = 'succeeded') AS n_delivered, CAST(max(epoch) AS BIGINT) AS n_requeued
FROM log GROUP BY internal_sku, platform"""),
    "sku_resolution_as_of": f"""WITH {INV},{DOCS},
ver AS (
  SELECT internal_sku, CASE WHEN _row % 4 = 1 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1990-01-01' END AS since, shopify_variant_id, shopify_sku, etsy_sku FROM inv
  UNION ALL
  SELECT internal_sku, TIMESTAMP '1997-01-01', NULL, 'SKU-' || (_row + 1), etsy_sku FROM inv WHERE _row % 6 = 1),
held AS (SELECT *, lead(since, 1, TIMESTAMP '9999-01-01') OVER (PARTITION BY internal_sku ORDER BY since) AS until FROM ver),
wanted AS (SELECT DISTINCT ts, platform, variant_id, nullif(trim(platform_sku), '') AS sku FROM lines),
v AS (SELECT w.ts, w.variant_id, min(internal_sku) AS s FROM (SELECT DISTINCT ts, variant_id FROM wanted WHERE platform = 'shopify') w
      JOIN held ON shopify_variant_id = w.variant_id AND since <= w.ts AND w.ts < until GROUP BY 1, 2),
c AS (SELECT w.ts, w.platform, w.sku, min(internal_sku) AS s FROM (SELECT DISTINCT ts, platform, sku FROM wanted) w
      JOIN (SELECT 'shopify' AS platform, shopify_sku AS sku, internal_sku, since, until FROM held
            UNION ALL SELECT 'etsy', etsy_sku, internal_sku, since, until FROM held) h
        ON h.platform = w.platform AND h.sku = w.sku AND since <= w.ts AND w.ts < until GROUP BY 1, 2, 3)
SELECT l.platform, l.external_event_id, CAST(l.delivery AS BIGINT) AS delivery, strftime(l.ts, '%Y-%m-%d') AS event_date, l.doc_pos, l.line_pos, l.tie1,
  l.platform_sku, l.variant_id, coalesce(v.s, c.s) AS internal_sku
FROM lines l LEFT JOIN v ON l.platform = 'shopify' AND v.ts = l.ts AND v.variant_id = l.variant_id
  LEFT JOIN c ON c.ts = l.ts AND c.platform = l.platform AND c.sku = nullif(trim(l.platform_sku), '')""",
}
