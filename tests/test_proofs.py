"""Checks that look at the data from another side than the ledger does."""

import json
import random

from pyspark.sql import functions as F

from stockflow.operators import outbox, reconcile, reports
from stockflow.plans.book import StockBook

SEQ = "seq struct<at:int>"


def test_an_injected_double_sale_is_found(spark):
    imports = spark.createDataFrame([("A", (1,), 10), ("A", (5,), 40), ("B", (1,), None), ("C", (1,), 3), ("GONE", (1,), 7)], f"internal_sku string, {SEQ}, available_units long")
    sales = spark.createDataFrame([("A", (2,), 9), ("A", (6,), 5), ("A", (9,), 1), ("B", (2,), 4), ("C", (2,), 2), ("C", (3,), 2)], f"internal_sku string, {SEQ}, quantity long")

    def proof(*live):
        items = spark.createDataFrame(list(live), "internal_sku string, available_units long")
        return {r.internal_sku: (r.proven_units, r.actual_units) for r in reconcile.stock_proof(imports, sales, items).collect()}

    good = [("A", 34), ("B", None), ("C", 0), ("GONE", 7)]
    assert proof(*good) == {}
    # One sale of A taken twice, a row that is missing, units from nowhere.
    assert proof(("A", 29), *good[1:3], ("X", 4)) == {"A": (34, 29), "GONE": (7, None), "X": (None, 4)}


def test_attempts_are_numbered_as_by_hand(spark):
    rnd = random.Random(1)
    log = []
    for i in range(900):
        job = 7 if rnd.random() < 0.4 else rnd.randrange(20)
        kind = "requeue" if rnd.random() < 0.15 else "attempt"
        ok, skip = rnd.random() < 0.2, "no route" if rnd.random() < 0.05 else None
        log.append((job, i, "etsy", kind, ok and skip is None, skip, None if ok or skip else "busy"))
    rnd.shuffle(log)
    want, state = [], {}
    for job, at, _, kind, ok, skip, _ in sorted(log, key=lambda r: r[1]):
        epoch, made, ended = state.get(job, (0, 0, False))
        if kind == "requeue":
            state[job] = (epoch + 1, 0, False)
            continue
        made += 1
        outcome = "skipped" if skip else "succeeded" if ok else "dead_letter" if made >= 5 else "retry_scheduled"
        want.append((job, at, epoch, made, outcome, ended))
        state[job] = (epoch, made, ended or outcome != "retry_scheduled")
    df = spark.createDataFrame(log, "job_id long, at long, platform string, kind string, ok boolean, skip_reason string, error string").repartition(6)
    got = outbox.number_attempts(df, ["job_id"], "at").select("job_id", "at", "epoch", "attempt_no", "outcome", "superfluous")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_percentiles_by_ranges(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(4000)) for _ in range(3000)] + [("c", 5)] + [("d", 1)] * 500
    got = {r.g: tuple(r)[1:] for r in reports.percentiles_nearest_rank(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    for g in "abcd":
        values = sorted(v for x, v in rows if x == g)
        n = len(values)
        assert got[g] == (n, *(values[min(n - 1, p * n // 100)] for p in (50, 95, 99)))


def test_details_of_a_run_are_kept(spark):
    book = StockBook(spark)
    book.import_inventory_rows([{"internal_sku": "A", "available_units": "9"}, {"internal_sku": "B", "available_units": "4"}])
    assert book.reconcile()["summary"].first().label == "clean"
    book.items = book.items.withColumn("available_units", F.when(F.col("internal_sku") == "A", 5).otherwise(F.col("available_units")))
    rep = book.reconcile()
    assert tuple(rep["summary"].first()) == (2, 1, 0, False, "drift")
    kept = book.run_details.collect()
    assert [(r.run_id, r.finding, json.loads(r.details)["delta"]) for r in kept] == [(2, "mismatch", -4)]


def test_reconcile_shuffles_little(spark):
    """Besides the range cut of the replay: the carry of the scan and the aggregate per SKU."""
    led = spark.range(2000).select(F.concat(F.lit("S"), F.col("id") % 50).alias("internal_sku"), F.struct(F.col("id").alias("at")).alias("seq"),
                                   F.lit(1).cast("long").alias("before_units"), F.lit(-1).cast("long").alias("change_units"), F.lit(0).cast("long").alias("after_units"))
    items = led.select("internal_sku").distinct().withColumn("available_units", F.lit(0).cast("long"))
    rep = reconcile.reconcile(led, items)
    assert rep["violations"].count() == 1950 and rep["summary"].first().checked_skus == 50
    for name, most in (("violations", 0), ("mismatches", 0), ("summary", 1)):
        plan = rep[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= most, plan
