"""Channel SKU -> internal SKU resolution (JN-1..4, SEM-7).

The reference looks up each line with ``shopify_sku = ? OR etsy_sku = ?``
(one side a sentinel) and ``LIMIT 1`` without an order. Here the distinct keys
asked for meet one dimension, deduplicated to one row per kind and channel key
(lowest ``internal_sku`` wins, so ambiguous mappings resolve
deterministically), in one equi-join by kind and key; keys that are null take no
part. The dimension grows with the catalogue, so it is never gathered whole. A
stream has an equi-join by variant and one by SKU instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.store import by_key


def lookup_dimensions(items: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """One row per channel key: variant id, Shopify SKU, Etsy SKU."""
    known = mapping.join(items.select("internal_sku"), "internal_sku", "left_semi")

    def dim(key: str, out: str) -> DataFrame:
        return (
            known.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(f"_{out}_key"))
            .agg(F.min("internal_sku").alias(out))
        )

    return {
        "variant": dim("shopify_variant_id", "_by_variant"),
        "shopify_sku": dim("shopify_sku", "_by_shopify_sku"),
        "etsy_sku": dim("etsy_sku", "_by_etsy_sku"),
    }


def ambiguous_mappings(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """SEM-7 report: channel keys shared by more than one internal SKU."""
    known = mapping.join(items.select("internal_sku"), "internal_sku", "left_semi")
    parts = []
    for kind, key in (("shopify_variant_id", "shopify_variant_id"),
                      ("shopify_sku", "shopify_sku"), ("etsy_sku", "etsy_sku")):
        parts.append(
            known.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("channel_key"))
            .agg(F.count("*").alias("n_skus"), F.min("internal_sku").alias("chosen_sku"),
                 F.max("internal_sku").alias("max_sku"))
            .filter("n_skus > 1")
            .withColumn("key_kind", F.lit(kind))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("key_kind", "channel_key", "n_skus", "chosen_sku", "max_sku")


def _asked(rows: DataFrame) -> DataFrame:
    """``rows`` with the three keys by which they are looked up; null: none."""
    shop, etsy = F.col("platform") == "shopify", F.col("platform") == "etsy"
    trimmed = F.nullif(F.trim(F.col("platform_sku")), F.lit(""))
    return rows.select("*", F.when(shop, F.col("variant_id")).alias("_variant_key"),
                       F.when(shop, trimmed).alias("_shop_key"), F.when(etsy, trimmed).alias("_etsy_key"))


def _found(asked: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """The distinct rows ``asked`` that a lookup finds, with ``internal_sku`` of the first that does."""

    def keys(*named: Column) -> Column:
        each = [F.when(c.isNotNull(), F.struct(F.lit(i).alias("_kind"), c.alias("_key"))) for i, c in enumerate(named)]
        return F.explode(F.array_compact(F.array(*each))).alias("_k")

    known = mapping.join(by_key(items.select("internal_sku")), "internal_sku", "left_semi")
    dim = known.select("internal_sku", keys(F.col("shopify_variant_id"), F.col("shopify_sku"), F.col("etsy_sku"))).groupBy(
        "_k._kind", "_k._key").agg(F.min("internal_sku").alias("_sku"))
    wanted = _asked(asked).select(*asked.columns, keys(F.col("_variant_key"), F.col("_shop_key"), F.col("_etsy_key"))).select(*asked.columns, "_k.*")
    return wanted.join(by_key(dim), ["_kind", "_key"]).groupBy(*asked.columns).agg(F.min(F.struct("_kind", "_sku"))["_sku"].alias("internal_sku"))


def _one_by_one(rows: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """``rows`` with ``internal_sku``: one join by variant, one by the SKU of the
    row's platform. Rows that ask for none match nothing; the salt spreads them
    over the partitions of the join."""
    dims = lookup_dimensions(items, mapping)
    channel = reduce(DataFrame.unionByName, [dims[f"{p}_sku"].select(F.lit(p).alias("_kind"), F.col(f"__by_{p}_sku_key").alias("_key"), F.col(f"_by_{p}_sku").alias("_by_channel"))
                                             for p in ("shopify", "etsy")])
    variant = dims["variant"].select(F.lit("variant").alias("_kind"), F.col("__by_variant_key").alias("_key"), "_by_variant")
    out = _asked(rows)
    for kind, asked, dim in ((F.lit("variant"), F.col("_variant_key"), variant), (F.col("platform"), F.coalesce("_shop_key", "_etsy_key"), channel)):
        salt = F.when(asked.isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(4096))).otherwise(F.lit(0))
        # Zero, but not a literal: the salt stays one of the keys that rows are dealt by.
        held = dim.withColumn("_salted", F.pmod(F.length("_key"), F.lit(1)).cast("long"))
        out = out.withColumn("_salt", salt).join(held, (asked == F.col("_key")) & (kind == F.col("_kind")) & (F.col("_salt") == F.col("_salted")), "left").drop(
            "_salt", "_salted", "_key", "_kind")
    return out.select(*rows.columns, F.coalesce("_by_variant", "_by_channel").alias("internal_sku"))


def resolve_lines(lines: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``internal_sku`` to canonical lines.

    Shopify: variant id hit, else trimmed SKU hit (a variant miss falls
    through). Etsy: trimmed SKU hit. Platform SKUs are matched trimmed but
    kept untrimmed (SEM-17).

    The lookups are made once for every combination that ``lines`` hold (read
    twice: they should be materialised); a line then meets its own in one
    join. A stream looks up its lines one by one.
    """
    if lines.isStreaming:
        return _one_by_one(lines, items, mapping)
    asked = ["platform", "platform_sku", "variant_id"]
    named = _found(lines.select(*asked).distinct(), items, mapping).select(*[F.col(c).alias(f"_{c}") for c in asked], "internal_sku")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked])
    return lines.join(named, same, "left").select(*lines.columns, "internal_sku")
