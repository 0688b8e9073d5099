"""Exactly one effect per (platform, event id) (WIN-1, JN-6, STR-2).

First arrival wins, including repeats inside one batch. The winner is the
minimum ``arrival`` per event - a partial/final aggregate, so an event that
is delivered millions of times costs one partial row per map task instead of
one giant window group. Lines follow their document through an equi semi-join
on ``(platform, event id, arrival)``, which is unique per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_KEY = ["platform", "external_event_id"]


def winning_documents(docs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Documents that take effect: first arrival per event, not already stored.

    ``docs`` needs ``platform, external_event_id, arrival`` (any orderable
    arrival key: batch id, file position, offset ...). ``store`` is the event
    store of earlier batches (``platform, external_event_id``).
    """
    first = docs.groupBy(*EVENT_KEY).agg(F.min("arrival").alias("arrival"))
    if store is not None:
        first = first.join(store.select(*EVENT_KEY), EVENT_KEY, "left_anti")
    return docs.join(first, [*EVENT_KEY, "arrival"], "left_semi")


def document_outcomes(docs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Every delivered document with ``status`` processed / duplicate /
    quarantined (no event id, hence no identity; see ``status_reason``)."""
    # One row per event key, so the join cannot multiply documents.
    first = docs.where(F.col("external_event_id").isNotNull()).groupBy(*EVENT_KEY).agg(F.min("arrival").alias("_first"))
    if store is not None:
        first = first.join(store.select(*EVENT_KEY), EVENT_KEY, "left_anti")
    # Sources give every document an arrival of its own; should two share one, one of them wins.
    place = F.row_number().over(Window.partitionBy(*EVENT_KEY, "arrival").orderBy("external_order_id"))
    nameless = F.col("external_event_id").isNull()
    # Documents without an id match nothing; the salt spreads them over the join's partitions.
    salt = F.when(nameless, F.pmod(F.xxhash64("arrival"), F.lit(4096))).otherwise(F.lit(0))
    return (
        docs.withColumn("_place", place).withColumn("_salt", salt)
        .join(first.withColumn("_salt", F.lit(0).cast("long")), [*EVENT_KEY, "_salt"], "left")
        .withColumn("status", F.when(nameless, F.lit("quarantined"))
                    .when((F.col("arrival") == F.col("_first")) & (F.col("_place") == 1), F.lit("processed"))
                    .otherwise(F.lit("duplicate")))
        .withColumn("status_reason", F.when(nameless, F.lit("document without an id")))
        .drop("_first", "_place", "_salt")
    )


def quarantined(outcomes: DataFrame, lines: DataFrame) -> DataFrame:
    """The quarantined documents of ``document_outcomes`` with raw payload
    (null if the source has none), ``lines`` in order and ``status_reason``."""
    kept = [c for c in ("seq", "platform_sku", "variant_id", "quantity", "quantity_valid", "unit_price", "title") if c in lines.columns]
    of = lines.where(F.col("external_event_id").isNull()).groupBy("platform", "arrival").agg(
        F.array_sort(F.collect_list(F.struct(*kept))).alias("lines"))
    raw = F.col("raw_payload") if "raw_payload" in outcomes.columns else F.lit(None)
    docs = outcomes.where(F.col("status") == "quarantined").select(
        "platform", "external_order_id", "order_name", "order_status", "arrival", raw.cast("string").alias("raw_payload"), "status", "status_reason")
    none = F.array().cast(of.schema["lines"].dataType)
    return docs.join(of, ["platform", "arrival"], "left").withColumn("lines", F.coalesce("lines", none))


def winning_lines(lines: DataFrame, winners: DataFrame) -> DataFrame:
    """Lines of the winning documents only."""
    return lines.join(winners.select(*EVENT_KEY, "arrival"), [*EVENT_KEY, "arrival"], "left_semi")
