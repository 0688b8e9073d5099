"""Ledger vs live stock (WIN-4..6, AGG-1/2, FLT-13, STA-8, SNK-12, PRJ-23/25).

The reference walks each SKU's ledger in id order (N+1 queries). Here:

* broken rows are a row predicate (no ordering needed);
* chain gaps need the previous row's ``after`` - an exclusive "last value"
  scan (:func:`keyed_scan`);
* the expected stock is ``max_by(after, seq)`` per SKU - a partial/final
  aggregate;
* drift is one join of that per-SKU aggregate with the live items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.scan import hot_keys, keyed_scan
from stockflow.store import materialize


def _checked_ledger(ledger: DataFrame, items: DataFrame) -> DataFrame:
    # Only SKUs of the snapshot are replayed (FLT-13 on the item side).
    return ledger.join(items.select("internal_sku"), "internal_sku", "left_semi")


def _with_previous(led: DataFrame, ledger: DataFrame) -> DataFrame:
    """The checked rows ``led`` of ``ledger`` with what the SKU's previous row ended at."""
    return keyed_scan(led, ["internal_sku"], "seq", last_before={"_prev": F.struct(F.col("after_units").alias("a"))}, hot=hot_keys(ledger, ["internal_sku"]))


def _broken() -> Column:
    return ~(F.coalesce(F.col("before_units"), F.lit(0)) + F.col("change_units")).eqNullSafe(F.col("after_units"))


def _broken_detail() -> Column:
    return F.format_string("before(%s) + change(%s) != after(%s)",
                           F.coalesce(F.col("before_units").cast("string"), F.lit("null")),
                           F.col("change_units").cast("string"),
                           F.coalesce(F.col("after_units").cast("string"), F.lit("null")))


def _gap() -> Column:
    prev_after = F.col("_prev")["a"]
    return F.col("before_units").isNotNull() & prev_after.isNotNull() & (F.col("before_units") != prev_after)


def _gap_detail() -> Column:
    return F.format_string("row starts at %d but previous row ended at %d", F.col("before_units"), F.col("_prev")["a"])


def broken_rows(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """WIN-4: ``coalesce(before, 0) + change`` is not (null-safe) ``after``."""
    led = _checked_ledger(ledger, items)
    return led.filter(_broken()).select("internal_sku", "seq", F.lit("broken_row").alias("type"), _broken_detail().alias("detail"))


def chain_gaps(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """WIN-5: ``before`` and the previous row's ``after`` both set and different."""
    led = _checked_ledger(ledger, items).select("internal_sku", "seq", "before_units", "after_units")
    prev = _with_previous(led, ledger)
    return prev.filter(_gap()).select("internal_sku", "seq", F.lit("chain_gap").alias("type"), _gap_detail().alias("detail"))


def expected_units(ledger: DataFrame) -> DataFrame:
    """AGG-2: the last ``after`` per SKU (null last value = no expectation)."""
    return ledger.groupBy("internal_sku").agg(
        F.max_by(F.struct(F.col("after_units").alias("a")), F.col("seq"))["a"].alias("expected_units"),
        F.count("*").alias("ledger_rows"),
    )


def stock_proof(imports: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """JN-13: live stock that imports and sales do not explain, without a look
    at the ledger: ``internal_sku, proven_units, actual_units``.

    A SKU's last import opens its segment; the units sold after it, taken once
    from the winning lines, are subtracted, down to zero. Both ways: SKUs with
    an import but no live row, and live units of SKUs without an import.
    ``imports`` and ``sales`` (``internal_sku, seq, quantity``) share the order ``seq``."""
    last = imports.groupBy("internal_sku").agg(F.max(F.struct("seq", "available_units")).alias("_i"))
    sold = sales.join(last, "internal_sku").where(F.col("seq") > F.col("_i.seq")).groupBy("internal_sku").agg(F.sum("quantity").alias("_q"))
    proven = last.join(sold, "internal_sku", "left").select(
        "internal_sku", F.lit(True).alias("_imported"),
        F.when(F.col("_i.available_units").isNotNull(), F.greatest(F.lit(0), F.col("_i.available_units") - F.coalesce("_q", F.lit(0)))).alias("proven_units"))
    live = items.select("internal_sku", F.lit(True).alias("_live"), F.col("available_units").alias("actual_units"))
    both = proven.join(live, "internal_sku", "full_outer")
    same = F.col("proven_units").eqNullSafe(F.col("actual_units")) & (F.col("_live").isNotNull() | F.col("_imported").isNull())
    return both.where(~same).select("internal_sku", "proven_units", "actual_units")


def drift(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """WIN-6: expected not null and actual not null-safe equal to it."""
    exp = expected_units(_checked_ledger(ledger, items))
    j = exp.join(items.select("internal_sku", F.col("available_units").alias("actual_units")), "internal_sku")
    return j.filter(F.col("expected_units").isNotNull()
                    & ~F.col("actual_units").eqNullSafe(F.col("expected_units"))).select(
        "internal_sku", "expected_units", "actual_units",
        (F.coalesce(F.col("actual_units"), F.lit(0)) - F.col("expected_units")).alias("delta"))


def summary(ledger: DataFrame, items: DataFrame, violations: DataFrame, mismatches: DataFrame) -> DataFrame:
    """AGG-1: one row: checked SKUs, mismatch and violation counts, consistent.

    One aggregate over a tagged union of the three inputs (no joins).
    """
    checked = _checked_ledger(ledger, items).select("internal_sku").distinct().select(F.lit("c").alias("k"))
    tagged = checked.unionByName(mismatches.select(F.lit("m").alias("k"))).unionByName(
        violations.select(F.lit("v").alias("k")))
    s = tagged.agg(
        F.count_if(F.col("k") == "c").alias("checked_skus"),
        F.count_if(F.col("k") == "m").alias("mismatch_count"),
        F.count_if(F.col("k") == "v").alias("chain_violation_count"),
    )
    return _labelled(s)


def _labelled(counts: DataFrame) -> DataFrame:
    return counts.select(
        "checked_skus", "mismatch_count", "chain_violation_count",
        ((F.col("mismatch_count") == 0) & (F.col("chain_violation_count") == 0)).alias("consistent"),
        F.when(F.col("mismatch_count") + F.col("chain_violation_count") > 0, F.lit("drift"))
        .otherwise(F.lit("clean")).alias("label"),
    )


def replay(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """The checked ledger with ``findings`` (type and detail) on every row:
    the ordered scan behind broken rows and chain gaps, done once and cut."""
    led = _checked_ledger(ledger, items).select("internal_sku", "seq", "before_units", "change_units", "after_units")
    scanned = _with_previous(led, ledger)
    found = F.array_compact(F.array(
        F.when(_broken(), F.struct(F.lit("broken_row").alias("type"), _broken_detail().alias("detail"))),
        F.when(_gap(), F.struct(F.lit("chain_gap").alias("type"), _gap_detail().alias("detail")))))
    return materialize(scanned.select("internal_sku", "seq", "after_units", found.alias("findings")))


def reconcile(ledger: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """STA-8: the three reports and the summary row, from one replay: findings
    are read off its rows, and one aggregate per SKU carries the expected
    value and the number of findings."""
    rows = replay(ledger, items)
    violations = rows.select("internal_sku", "seq", F.explode("findings").alias("f")).select("internal_sku", "seq", "f.type", "f.detail")
    per_sku = rows.groupBy("internal_sku").agg(
        F.max_by(F.struct(F.col("after_units").alias("a")), F.col("seq"))["a"].alias("expected_units"), F.sum(F.size("findings")).alias("violations"))
    # The aggregate joins live stock on the key it is already dealt by.
    checked = materialize(per_sku.join(items.select("internal_sku", F.col("available_units").alias("actual_units")), "internal_sku").withColumn(
        "differs", F.col("expected_units").isNotNull() & ~F.col("actual_units").eqNullSafe(F.col("expected_units"))))
    mismatches = checked.where("differs").select("internal_sku", "expected_units", "actual_units",
                                                 (F.coalesce(F.col("actual_units"), F.lit(0)) - F.col("expected_units")).alias("delta"))
    counts = checked.agg(F.count(F.lit(1)).alias("checked_skus"), F.count_if("differs").alias("mismatch_count"),
                         F.coalesce(F.sum("violations"), F.lit(0)).alias("chain_violation_count"))
    return {"violations": violations, "mismatches": mismatches, "summary": _labelled(counts)}


def run_record(report: dict[str, DataFrame], run_id: int) -> DataFrame:
    """SNK-12: the persisted run row (counts) of a reconcile run."""
    return report["summary"].select(
        F.lit(run_id).cast("long").alias("run_id"), "checked_skus", "mismatch_count",
        "chain_violation_count", "consistent", "label")


def run_details(report: dict[str, DataFrame], run_id: int) -> DataFrame:
    """PRJ-23: the run's details as one JSON document per finding.

    The reference stores one JSON text holding both lists; here each finding
    is its own row tagged with ``run_id`` (``to_json`` per row), so a run
    with millions of findings never funnels through one task.
    """
    mm = report["mismatches"].select(
        F.lit("mismatch").alias("finding"), "internal_sku",
        F.to_json(F.struct("internal_sku", "expected_units", "actual_units", "delta")).alias("details"))
    vv = report["violations"].select(
        F.lit("chain_violation").alias("finding"), "internal_sku",
        F.to_json(F.struct("internal_sku", F.col("seq").alias("ledger_seq"), "type", "detail")).alias("details"))
    return mm.unionByName(vv).select(F.lit(run_id).cast("long").alias("run_id"), "*")
