"""Column normalisers for loosely typed inputs (CSV cells, JSON scalars).

All functions take and return ``Column`` objects and stay JVM-side; they are
meant for ``select`` / ``withColumn`` over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockflow import schemas as S

# Decimal number text as a JavaScript ``Number()`` call accepts it (no hex).
_DECIMAL_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_HEX_RE = r"^\s*0[xX][0-9a-fA-F]+\s*$"
_OCT_RE = r"^\s*0[oO][0-7]+\s*$"
_BIN_RE = r"^\s*0[bB][01]+\s*$"


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def blank_to_null(c: Column | str) -> Column:
    """PRJ-4: empty text is "no value"."""
    return F.nullif(_text(c), F.lit(""))


def tier(c: Column | str) -> Column:
    """PRJ-1: trim + lower; anything outside the three tiers is tier3."""
    v = F.lower(F.trim(F.coalesce(_text(c), F.lit(""))))
    return F.when(v.isin(*S.TIERS), v).otherwise(F.lit(S.DEFAULT_TIER))


def flag(c: Column | str, default: bool = False) -> Column:
    """PRJ-2: null / '' -> default; 1,true,yes,y (trimmed, any case) -> 1; else 0."""
    t = _text(c)
    return (
        F.when(t.isNull() | (t == ""), F.lit(1 if default else 0))
        .otherwise(F.lower(F.trim(t)).isin(*S.TRUTHY_FLAGS).cast("int"))
    )


def nullable_int(c: Column | str) -> Column:
    """PRJ-3: number text -> long truncated toward zero; blank / not a number -> null.

    Whitespace-only text counts as 0 and 0x/0o/0b literals are accepted, as a
    JavaScript ``Number()`` would do.
    """
    t = _text(c)
    s = F.trim(t)
    dec = t.try_cast("double").try_cast("bigint")
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("bigint"))
        .when(s == "", F.lit(0).cast("bigint"))
        .when(t.rlike(_DECIMAL_RE), dec)
        .when(t.rlike(_HEX_RE), F.conv(F.substring(s, 3, 64), 16, 10).try_cast("bigint"))
        .when(t.rlike(_OCT_RE), F.conv(F.substring(s, 3, 64), 8, 10).try_cast("bigint"))
        .when(t.rlike(_BIN_RE), F.conv(F.substring(s, 3, 64), 2, 10).try_cast("bigint"))
        .otherwise(F.lit(None).cast("bigint"))
    )


def quantity(c: Column | str) -> tuple[Column, Column]:
    """PRJ-13: line quantity; missing -> 0.

    Returns ``(value, valid)``: value is the whole number (null when the text
    is not a whole number), valid is false for text or fractional quantities
    (SEM-6: such lines are reported unresolved instead of failing the order).
    """
    t = _text(c)
    d = F.when(t.isNull() | (t == ""), F.lit(0.0)).otherwise(
        F.when(t.rlike(_DECIMAL_RE), t.try_cast("double"))
    )
    whole = d.isNotNull() & (d == F.floor(d))
    value = F.when(whole, d.try_cast("bigint"))
    return value, whole & value.isNotNull()


def threshold(c: Column | str, default: int = S.DEFAULT_LOW_STOCK_THRESHOLD) -> Column:
    """PRJ-5: null (not 0) falls back to the default threshold."""
    return F.coalesce(nullable_int(c), F.lit(default).cast("bigint"))


def location(c: Column | str, default: str | None = None) -> Column:
    """PRJ-8: configured default location when the cell is blank."""
    v = blank_to_null(c)
    return F.coalesce(v, F.lit(default).cast("string")) if default else v


def first_truthy(*cols: Column | str) -> Column:
    """PRJ-10: first value that is not null, '' or 0 (JavaScript ``a || b || c``)."""
    parts = []
    for c in cols:
        t = _text(c)
        parts.append(F.when(~t.isin("", "0"), t))
    return F.coalesce(*parts)


def import_rows(raw, default_location: str | None = None):
    """STA-6 projection: raw inventory rows (text cells) -> item + mapping columns.

    PRJ-6/7 branch on whether the flag columns exist at all (plan-time check).
    Extra columns (e.g. ``seq``) pass through untouched.
    """
    cols = set(raw.columns)
    t = tier("tier") if "tier" in cols else F.lit(S.DEFAULT_TIER)
    if "sync_enabled" in cols:
        sync = flag("sync_enabled", False)
    else:
        sync = F.when(t == "tier1", F.lit(1)).otherwise(F.lit(0))
    monitor = flag("monitoring_enabled", True) if "monitoring_enabled" in cols else F.lit(1)

    def opt(name: str) -> Column:
        return blank_to_null(name) if name in cols else F.lit(None).cast("string")

    def opt_int(name: str) -> Column:
        return nullable_int(name) if name in cols else F.lit(None).cast("bigint")

    passthrough = [c for c in raw.columns if c not in S.INVENTORY_COLUMNS]
    return raw.select(
        *passthrough,
        F.col("internal_sku").cast("string").alias("internal_sku"),
        opt("product_name").alias("product_name"),
        t.alias("tier"),
        sync.alias("sync_enabled"),
        monitor.alias("monitoring_enabled"),
        opt_int("available_units").alias("available_units"),
        (threshold("low_stock_threshold") if "low_stock_threshold" in cols
         else F.lit(S.DEFAULT_LOW_STOCK_THRESHOLD).cast("bigint")).alias("low_stock_threshold"),
        opt_int("units_per_pack").alias("units_per_pack"),
        opt("notes").alias("notes"),
        opt("shopify_sku").alias("shopify_sku"),
        opt("shopify_variant_id").alias("shopify_variant_id"),
        opt("shopify_inventory_item_id").alias("shopify_inventory_item_id"),
        (location("shopify_location_id", default_location) if "shopify_location_id" in cols
         else F.lit(default_location).cast("string")).alias("shopify_location_id"),
        opt("etsy_sku").alias("etsy_sku"),
        opt("etsy_listing_id").alias("etsy_listing_id"),
        opt("etsy_offering_id").alias("etsy_offering_id"),
    )
