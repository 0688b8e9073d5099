"""JN-1..4 as of ``seq``: lines are resolved with the mapping in force when
they happened, so a sale before its SKU's import is ``unresolved`` in one batch
as in two.

Every import replaces its SKU's channel keys. Per channel key that gives
intervals of the key's own sequence of changes, in which a SKU holds it; the
lowest holder wins, as in :mod:`stockflow.operators.resolve`. The lowest holder
after each change comes from equi-joins alone: an interval is cut into at most
two aligned blocks a level (sizes 1, 2, 4, ...), the lowest SKU is taken per
block, and each change looks up the blocks that contain it, one a level. With
n changes of a key that is n log n rows, however many SKUs share it. A line
then takes the last change before it in one ordered stream of changes and
lines; a key of very many lines is cut into chunks, so it is no hot task.
Lines without a key take no part in any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.operators.scan import CHUNK, hot_keys, keyed_scan, ordered_scan

KINDS = {"variant": "shopify_variant_id", "shopify": "shopify_sku", "etsy": "etsy_sku"}
KEY = ["kind", "key"]


def version_rows(mapping: DataFrame | None, imports: DataFrame) -> DataFrame:
    """The mapping before a batch, sorted first, and the imports of the batch."""
    cols = ["internal_sku", "seq", *KINDS.values()]
    if mapping is None:
        return imports.select(*cols)
    first = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in imports.schema["seq"].dataType.fields])
    return mapping.withColumn("seq", first).select(*cols).unionByName(imports.select(*cols))


def key_changes(versions: DataFrame, materialize=None) -> DataFrame:
    """``(kind, key, seq, internal_sku, holds, pos)``: a SKU takes or gives up
    a channel key; ``pos`` counts the key's changes from 1. ``versions`` has
    ``internal_sku, seq`` (a total order inside a SKU) and the keys."""
    keys = F.struct(*KINDS.values())
    held = ordered_scan(versions.select("internal_sku", "seq", *KINDS.values()), ["internal_sku"], "seq", last_before={"_old": keys}, materialize=materialize)

    def change(kind: str, key: Column, other: Column, holds: bool) -> Column:
        return F.when(key.isNotNull() & ~key.eqNullSafe(other), F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(holds).alias("holds")))

    steps = [c for k, name in KINDS.items() for c in (change(k, F.col("_old")[name], F.col(name), False), change(k, F.col(name), F.col("_old")[name], True))]
    out = held.select("internal_sku", "seq", F.explode(F.array_compact(F.array(*steps))).alias("_c")).select("internal_sku", "seq", "_c.*")
    return ordered_scan(out, KEY, "seq", sums={"pos": F.lit(1)}, materialize=materialize).drop(CHUNK)


def holders(changes: DataFrame) -> DataFrame:
    """``(kind, key, seq, holder)``: the lowest SKU that holds the key after
    the changes at each ``seq`` (null: none)."""
    levels = changes.groupBy(*KEY).agg(F.length(F.bin(F.max("pos"))).alias("top"))
    placed = changes.join(levels, KEY)
    until = F.lead("pos").over(Window.partitionBy(*KEY, "internal_sku").orderBy("pos"))
    spans = placed.withColumn("until", F.coalesce(until, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top")))).where("holds")
    blocks = spans.select(*KEY, "internal_sku", F.explode(F.expr("""
        filter(flatten(transform(sequence(0, top), j -> array(
            struct(j AS level, shiftright(pos + shiftleft(1L, j) - 1, j) AS block,
                   shiftright(pos + shiftleft(1L, j) - 1, j) < shiftright(until, j) AND shiftright(pos + shiftleft(1L, j) - 1, j) % 2 = 1 AS used),
            struct(j AS level, shiftright(until, j) - 1 AS block,
                   shiftright(pos + shiftleft(1L, j) - 1, j) < shiftright(until, j) AND shiftright(until, j) % 2 = 1 AS used)))), b -> b.used)""")).alias("_b"))
    lowest = blocks.groupBy(*KEY, "_b.level", "_b.block").agg(F.min("internal_sku").alias("_lowest"))
    looked = placed.select(*KEY, "seq", "pos", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")).withColumn("block", F.expr("shiftright(pos, level)"))
    after = looked.join(lowest, [*KEY, "level", "block"], "left").groupBy(*KEY, "pos").agg(F.first("seq").alias("seq"), F.min("_lowest").alias("holder"))
    # SKUs of the mapping before a batch take a key at one place: what holds after all of them counts.
    return after.groupBy(*KEY, "seq").agg(F.max_by(F.struct("holder"), "pos")["holder"].alias("holder"))


def _look_up(lines: DataFrame, kind: Column, key: Column, timeline: DataFrame, out: str, materialize=None) -> DataFrame:
    """``lines`` with the holder of ``key`` when each happened."""
    asked = lines.withColumn("kind", kind).withColumn("key", key)
    known = (F.col("kind").isNotNull() & F.col("key").isNotNull())
    stream = asked.where(known).withColumn("_step", F.lit(None).cast("struct<holder:string>")).unionByName(
        timeline.select(*KEY, "seq", F.struct("holder").alias("_step")).withColumn("_is_step", F.lit(True)), allowMissingColumns=True)
    found = keyed_scan(stream, KEY, "seq", last_before={"_at": F.col("_step")}, materialize=materialize, hot=hot_keys(stream, KEY, materialize)).where("_is_step IS NULL")
    return found.select(*lines.columns, F.col("_at.holder").alias(out)).unionByName(
        asked.where(~known).select(*lines.columns, F.lit(None).cast("string").alias(out)))


def resolve_as_of(lines: DataFrame, versions: DataFrame, materialize=None) -> DataFrame:
    """Canonical lines with ``internal_sku`` as of their ``seq``: Shopify by
    variant id, else by trimmed SKU; Etsy by trimmed SKU. ``seq`` has the same
    type in ``versions`` and ``lines``."""
    if materialize is None:
        from stockflow.store import materialize
    timeline = materialize(holders(materialize(key_changes(versions, materialize))))
    shop, etsy = F.col("platform") == "shopify", F.col("platform") == "etsy"
    trimmed = F.nullif(F.trim("platform_sku"), F.lit(""))
    step = _look_up(lines, F.when(shop, F.lit("variant")), F.col("variant_id"), timeline, "_variant_sku", materialize)
    step = _look_up(step, F.when(shop, F.lit("shopify")).when(etsy, F.lit("etsy")), trimmed, timeline, "_channel_sku", materialize)
    return step.select(*lines.columns, F.coalesce("_variant_sku", "_channel_sku").alias("internal_sku"))
