"""Read models and audits (JN-5/12/13, FLT-2/4, SRT-2..4, AGG-4..11).

All reports are whole-table DataFrames; sorting is left to the caller or
done as a top-k (``orderBy().limit()`` -> TakeOrderedAndProject) where the
limit is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.operators.scan import ordered_scan
from stockflow.sources.orders_json import line_index


def inventory_snapshot(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN-5: items with their Shopify / Etsy SKU (left join on the SKU key)."""
    return items.join(mapping.select("internal_sku", "shopify_sku", "etsy_sku"), "internal_sku", "left")


def low_stock(items: DataFrame) -> DataFrame:
    """FLT-2: monitored, units and threshold set, units <= threshold."""
    return items.filter(
        (F.col("monitoring_enabled") == 1) & F.col("available_units").isNotNull()
        & F.col("low_stock_threshold").isNotNull()
        & (F.col("available_units") <= F.col("low_stock_threshold")))


def low_stock_flag(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN-12: snapshot rows flagged when the SKU is in the low-stock list."""
    low = low_stock(items).select("internal_sku").distinct().withColumn("is_low_stock", F.lit(True))
    snap = inventory_snapshot(items, mapping)
    return snap.join(low, "internal_sku", "left").withColumn(
        "is_low_stock", F.coalesce(F.col("is_low_stock"), F.lit(False)))


def recent(df: DataFrame, order_cols: list, limit: int = S.RECENT_DEFAULT_LIMIT) -> DataFrame:
    """SRT-2/3: the ``limit`` newest rows (a top-k report)."""
    return df.orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order_cols]).limit(max(0, int(limit)))


def status_counts(df: DataFrame, col: str = "status") -> DataFrame:
    """AGG-4/5/11: counts per status value."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def double_delivery(logs: DataFrame) -> DataFrame:
    """AGG-10: pairs with more than one successful delivery."""
    return (logs.filter(F.col("outcome") == "succeeded")
            .groupBy("internal_sku", "platform").agg(F.count("*").alias("n"))
            .filter(F.col("n") > 1))


def kpis(items: DataFrame, jobs: DataFrame, runs_summary: DataFrame | None = None) -> DataFrame:
    """AGG-6: one KPI row: SKUs, units on hand (null as 0), low stock, pending,
    dead letters and the last reconcile label; counts all jobs (SEM-13).

    One aggregate over a tagged union, no joins between the inputs.
    """
    low = low_stock(items).select("internal_sku")
    parts = [
        items.select(F.lit("i").alias("k"), F.coalesce("available_units", F.lit(0)).cast("long").alias("u"),
                     F.lit(None).cast("string").alias("s")),
        low.select(F.lit("l").alias("k"), F.lit(0).cast("long").alias("u"), F.lit(None).cast("string").alias("s")),
        jobs.select(F.lit("j").alias("k"), F.lit(0).cast("long").alias("u"), F.col("status").alias("s")),
    ]
    if runs_summary is not None:
        # The run number travels as ``u``: the last run is the one with the largest.
        run = F.col("run_id").cast("long") if "run_id" in runs_summary.columns else F.lit(1).cast("long")
        parts.append(runs_summary.select(F.lit("r").alias("k"), run.alias("u"), F.col("label").alias("s")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(
        F.count_if(F.col("k") == "i").alias("sku_count"),
        F.coalesce(F.sum(F.when(F.col("k") == "i", F.col("u"))), F.lit(0)).cast("long").alias("units_on_hand"),
        F.count_if(F.col("k") == "l").alias("low_stock_count"),
        F.count_if((F.col("k") == "j") & (F.col("s") == "pending")).alias("pending_jobs"),
        F.count_if((F.col("k") == "j") & (F.col("s") == "dead_letter")).alias("dead_letter_jobs"),
        F.coalesce(F.max_by("s", F.when(F.col("k") == "r", F.col("u"))), F.lit("never")).alias("last_run_label"),
    )


def percentiles_nearest_rank(df: DataFrame, group_cols: list[str], value: str,
                             ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """AGG-7: element ``min(n-1, floor(p/100*n))`` of each group's sorted values.

    Exact and skew-safe: values are first counted per (group, value) with a
    partial/final aggregate; the histogram is cut into ranges of its order,
    ranges are counted, and the running count inside a range starts from the
    ranges before it (:func:`stockflow.operators.scan.ordered_scan`), so no
    group, however many values it has, meets in one task.
    """
    hist = df.groupBy(*group_cols, value).agg(F.count("*").alias("_c"))
    hist = ordered_scan(hist, group_cols, value, sums={"_cum": F.col("_c")})
    hist = hist.join(hist.groupBy(*group_cols).agg(F.sum("_c").alias("_n")), group_cols)
    out = hist
    aggs = []
    for p in ps:
        idx = F.least(F.col("_n") - 1, F.floor(F.lit(p) / 100.0 * F.col("_n")).cast("long"))
        # The value at 0-based rank idx: first value whose cumulative count exceeds idx.
        hit = (F.col("_cum") > idx) & (F.col("_cum") - F.col("_c") <= idx)
        aggs.append(F.max(F.when(hit, F.col(value))).alias(f"p{p}"))
    return out.groupBy(*group_cols).agg(F.max("_n").alias("n"), *aggs)


def throughput(df: DataFrame, group_cols: list[str], ts: str) -> DataFrame:
    """AGG-8: rows per second between the first and last timestamp of each group."""
    g = df.groupBy(*group_cols).agg(F.count("*").alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    secs = F.unix_seconds(F.col("t1").cast("timestamp")) - F.unix_seconds(F.col("t0").cast("timestamp"))
    return g.select(*group_cols, "n", secs.alias("seconds"),
                    F.when(secs > 0, F.round(F.col("n") / secs, 6)).alias("rows_per_second"))


def orphan_checks(items: DataFrame, mapping: DataFrame, ledger: DataFrame,
                  events: DataFrame, event_lines: DataFrame) -> DataFrame:
    """JN-16: rows whose parent is missing (the FKs of the reference), as counts."""
    def cnt(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    sku = items.select("internal_sku")
    ev = events.select("platform", "external_event_id")
    out = cnt(mapping.join(sku, "internal_sku", "left_anti"), "mapping_without_item")
    out = out.unionByName(cnt(ledger.join(sku, "internal_sku", "left_anti"), "ledger_without_item"))
    out = out.unionByName(cnt(event_lines.join(ev, ["platform", "external_event_id"], "left_anti"),
                              "line_without_event"))
    return out


def nested_results(line_results: DataFrame, documents: DataFrame) -> DataFrame:
    """AGG-12: line results collected under their order, in line order, as JSON.

    One group per order (bounded by the lines of one document).
    """
    item = F.struct(
        line_index(F.col("seq.line_pos")).alias("line_pos"), F.col("seq.tie1").alias("tie1"),
        "internal_sku", "quantity", "status")
    g = line_results.groupBy("platform", "external_order_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n_lines"))
    g = g.select("platform", "external_order_id", "n_lines",
                 F.to_json("items", {"ignoreNullFields": "false"}).alias("items_json"))
    docs = documents.filter(F.col("status") == "processed").select("platform", "external_order_id", "status")
    return docs.join(g, ["platform", "external_order_id"], "left").select(
        "platform", "external_order_id", "status", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("items_json", F.lit("[]")).alias("items_json"))


def order_results(line_results: DataFrame, documents: DataFrame) -> DataFrame:
    """AGG-12: the answer to every delivered document, as ``arrival`` and JSON.

    A processed document lists its lines in order: an unresolved one with
    ``platformSku``, ``status`` and ``message`` (as delivered, null too), an
    applied one with SKU, quantity, status, message and, where the SKU has unit
    stock, the units before and after and whether it was oversold. A duplicate
    has no ``items``; a quarantined document tells its reason. One group per
    order, bounded by the lines of one document.
    """
    text = {"ignoreNullFields": "false"}
    unresolved = F.to_json(F.struct(F.col("platform_sku").alias("platformSku"), "status", "message"), text)
    sold = [F.col("internal_sku").alias("internalSku"), "quantity", "status", "message"]
    units = [F.col("before_units").alias("beforeUnits"), F.col("after_units").alias("afterUnits"), "oversold"]
    item = (F.when(F.col("internal_sku").isNull(), unresolved).when(F.col("before_units").isNull(), F.to_json(F.struct(*sold), text))
            .otherwise(F.to_json(F.struct(*sold, *units), text)))
    lines = line_results.groupBy("platform", "external_order_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("items", F.array().cast(lines.schema["items"].dataType)), lambda x: x["item"]), ","), F.lit("]"))
    head = F.to_json(F.struct("platform", F.col("external_order_id").alias("orderId"), "status", F.col("status_reason").alias("reason")))
    # Only the document that took effect meets its lines; the others need none.
    answers = documents.select("platform", "external_order_id", "arrival", "status", head.alias("_head"))
    done = answers.where(F.col("status") == "processed").join(lines, ["platform", "external_order_id"], "left").withColumn(
        "result", F.concat(F.regexp_replace("_head", r"}$", ""), F.lit(',"items":'), items, F.lit("}")))
    rest = answers.where(F.col("status") != "processed").withColumn("result", F.col("_head"))
    cols = ["platform", "external_order_id", "arrival", "status", "result"]
    return done.select(*cols).unionByName(rest.select(*cols))
