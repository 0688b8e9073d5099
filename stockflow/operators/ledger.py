"""Stock changes applied in order: imports set stock, sales decrement it.

One change stream per SKU, three row kinds:

* ``state``  - the live item as it was before this batch (no ledger row);
* ``import`` - an inventory import row: sets units and attributes (STA-6);
* ``sale``   - a resolved, valid order line of quantity ``q > 0``.

The sequential fold of the reference (WIN-2/WIN-3) is rewritten as two
ordered scans per SKU (see :mod:`stockflow.operators.scan`):

* ``cum``  - running sum of sale quantities (inclusive);
* ``prev`` - the latest state/import row strictly before this row, carried
  as a struct ``(units, tier, sync_enabled, cum)``.

Because every sale has ``q > 0`` the clamped fold ``after = max(0, before -
q)`` equals ``max(0, base - (cum - prev.cum))`` where ``base`` is the units
set by ``prev``; ``before`` is the same expression with ``q`` added back.
An import's old value is the live value just before it, computed the same way
from its own ``prev``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.operators.scan import hot_keys, keyed_scan, ordered_scan

KIND_STATE, KIND_IMPORT, KIND_SALE = -1, 0, 1

CHANGE_COLUMNS = [
    "internal_sku", "seq", "row_kind", "quantity", "available_units", "tier", "sync_enabled",
    "platform", "external_order_id", "note",
]


def state_rows(items: DataFrame) -> DataFrame:
    """Live items before the batch, as change rows sorted first."""
    return items.select(
        "internal_sku",
        F.struct(
            F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(KIND_STATE).alias("kind"),
            F.lit(None).cast("long").alias("doc_pos"), F.lit(None).cast("long").alias("line_pos"),
            F.lit(None).cast("long").alias("tie1"), F.lit(None).cast("double").alias("tie2"),
        ).alias("seq"),
        F.lit("state").alias("row_kind"),
        F.lit(None).cast("long").alias("quantity"),
        F.col("available_units").cast("long").alias("available_units"),
        "tier", F.col("sync_enabled").cast("int").alias("sync_enabled"),
        F.lit(None).cast("string").alias("platform"),
        F.lit(None).cast("string").alias("external_order_id"),
        F.lit(None).cast("string").alias("note"),
    )


def import_rows(imports: DataFrame) -> DataFrame:
    """Normalised import rows (with a ``seq`` column) as change rows."""
    return imports.select(
        "internal_sku", "seq", F.lit("import").alias("row_kind"),
        F.lit(None).cast("long").alias("quantity"),
        F.col("available_units").cast("long").alias("available_units"),
        "tier", F.col("sync_enabled").cast("int").alias("sync_enabled"),
        F.lit(None).cast("string").alias("platform"),
        F.lit(None).cast("string").alias("external_order_id"),
        F.lit(None).cast("string").alias("note"),
    )


def sale_rows(sales: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Resolved valid lines ``(internal_sku, seq, quantity, platform, external_order_id, note)``."""
    extra = extra or []
    return sales.select(
        "internal_sku", "seq", F.lit("sale").alias("row_kind"),
        F.col("quantity").cast("long").alias("quantity"),
        F.lit(None).cast("long").alias("available_units"),
        F.lit(None).cast("string").alias("tier"),
        F.lit(None).cast("int").alias("sync_enabled"),
        "platform", "external_order_id", "note", *extra,
    )


def _oversell_note(note: Column, requested: Column, before: Column) -> Column:
    prefix = F.when(F.coalesce(note, F.lit("")) != "", F.concat(note, F.lit(" "))).otherwise(F.lit(""))
    return F.concat(prefix, F.format_string(S.OVERSELL_NOTE_FORMAT, requested, before))


def apply_changes(changes: DataFrame, inline_push: bool = False, materialize=None, chunks: int | None = None) -> DataFrame:
    """Fold the change stream; returns every change row with its effect.

    Added columns: ``before_units``, ``after_units``, ``change_units``,
    ``oversold``, ``writes_ledger``, ``ledger_notes``, ``status``,
    ``message``, ``push_eligible``, ``value_after`` (stock right after the
    row, null when the SKU has no unit stock), ``item_tier``,
    ``item_sync_enabled`` (attributes in force for the row).

    ``changes`` is read to count the rows of its SKUs and for its rows: its
    sources should be materialised. ``chunks``: every SKU is scanned in chunks,
    as in :func:`ordered_scan`.
    """
    is_sale = F.col("row_kind") == "sale"
    marker = F.when(~is_sale, F.struct(F.col("available_units").alias("units"), "tier", "sync_enabled"))
    columns = {"sums": {"cum": F.when(is_sale, F.col("quantity")).otherwise(F.lit(0))}, "last_before": {"_prev": marker}}
    if chunks:
        scanned = ordered_scan(changes, ["internal_sku"], "seq", **columns, chunks=chunks, materialize=materialize, stamp=True)
    else:
        scanned = keyed_scan(changes, ["internal_sku"], "seq", **columns, materialize=materialize, stamp=True,
                             hot=hot_keys(changes, ["internal_sku"], materialize))
    scanned = scanned.withColumnRenamed("cum", "_cum")
    return effects(scanned, changes.columns, inline_push)


def effects(scanned: DataFrame, columns: list[str], inline_push: bool = False) -> DataFrame:
    """What every change row does, from ``_cum`` (units sold so far, this row
    included) and ``_prev`` (the state or import row in force before it, with
    the units sold up to there). ``columns`` are kept; the rest as in
    :func:`apply_changes`. Looks at no other row."""
    is_sale = F.col("row_kind") == "sale"
    prev = F.col("_prev")
    has_prev = prev.isNotNull()
    base = prev["units"]
    seg_cum = F.col("_cum") - prev["cum"]
    q = F.col("quantity")
    sale_after = F.greatest(F.lit(0), base - seg_cum)
    sale_before = F.greatest(F.lit(0), base - seg_cum + q)
    import_old = F.when(has_prev & base.isNotNull(), F.greatest(F.lit(0), base - seg_cum))
    new_units = F.col("available_units")

    tier_now = F.when(is_sale, prev["tier"]).otherwise(F.col("tier"))
    sync_now = F.when(is_sale, prev["sync_enabled"]).otherwise(F.col("sync_enabled"))
    tracked = is_sale & has_prev & base.isNotNull()
    push = tracked & (prev["tier"] == "tier1") & (prev["sync_enabled"] == 1)
    oversold = tracked & ((sale_before - q) < 0)
    writes_import = (F.col("row_kind") == "import") & new_units.isNotNull() & ~new_units.eqNullSafe(import_old)

    before = F.when(tracked, sale_before).when(writes_import, import_old)
    after = F.when(tracked, sale_after).when(writes_import, new_units)
    change = F.when(tracked, sale_after - sale_before).when(
        writes_import, new_units - F.coalesce(import_old, F.lit(0)))
    notes = (
        F.when(tracked & oversold, _oversell_note(F.col("note"), q, sale_before))
        .when(tracked, F.nullif(F.col("note"), F.lit("")))
        .when(writes_import, F.when(has_prev, F.lit(S.NOTE_IMPORT_CHANGED)).otherwise(F.lit(S.NOTE_INITIAL_IMPORT)))
    )
    msg = S.STATUS_MESSAGES
    status = (
        F.when(~is_sale, F.lit(None).cast("string"))
        .when(~has_prev, F.lit("unresolved"))
        .when(base.isNull(), F.lit("tracked_only"))
        .when(push, F.lit("synced" if inline_push else "enqueued"))
        .when(prev["tier"] == "tier2", F.lit("tracked_only"))
        .otherwise(F.lit("manual"))
    )
    if inline_push:
        push_msg = F.when(oversold, F.lit(msg["synced_oversold"])).otherwise(F.lit(msg["synced"]))
    else:
        push_msg = F.lit(msg["enqueued"])
    message = (
        F.when(~is_sale, F.lit(None).cast("string"))
        .when(~has_prev, F.lit(msg["unresolved"]))
        .when(base.isNull(), F.lit(msg["no_unit_stock"]))
        .when(push, push_msg)
        .when(prev["tier"] == "tier2", F.lit(msg["tier2"]))
        .otherwise(F.lit(msg["tier3"]))
    )
    value_after = F.when(is_sale, F.when(tracked, sale_after)).otherwise(new_units)
    return scanned.select(
        *columns,
        before.alias("before_units"),
        after.alias("after_units"),
        change.alias("change_units"),
        F.when(is_sale & tracked, oversold).alias("oversold"),
        (tracked | writes_import).alias("writes_ledger"),
        notes.alias("ledger_notes"),
        status.alias("status"),
        message.alias("message"),
        push.alias("push_eligible"),
        value_after.alias("value_after"),
        tier_now.alias("item_tier"),
        sync_now.alias("item_sync_enabled"),
    )


def ledger_rows(applied: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """SNK-2: the append-only ledger rows of an applied change stream."""
    extra = extra or []
    return applied.filter("writes_ledger").select(
        "internal_sku", "seq",
        F.when(F.col("row_kind") == "sale", F.lit(S.REASON_SALE)).otherwise(F.lit(S.REASON_IMPORT)).alias("reason"),
        "platform", "external_order_id", "change_units", "before_units", "after_units",
        F.col("ledger_notes").alias("notes"), *extra,
    )


def final_units(applied: DataFrame) -> DataFrame:
    """SNK-6: stock per SKU after the last change (``max_by`` on ``seq``)."""
    return applied.groupBy("internal_sku").agg(
        F.max_by(F.struct(F.col("value_after").alias("v")), F.col("seq"))["v"].alias("available_units")
    )
