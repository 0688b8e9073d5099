"""Write-back outbox as table transitions (STA-1..5, FLT-3/6/7, PRJ-18..20).

The outbox is a versioned DataFrame of jobs (``schemas.PUSH_JOB``). Every
operator takes the current version and returns the next one (plus side
outputs such as attempt-log rows); nothing is updated in place. ``now_ms``
is always a parameter.

Job identity: ``job_id = xxhash64(internal_sku, platform, created_batch)``
masked to a non-negative long - deterministic, computed row-locally (no
global numbering pass), and unique per (pair, batch) because a batch creates
at most one job per pair.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.operators.scan import ordered_scan
from stockflow.store import by_key

PAIR = ["internal_sku", "platform"]
JOB_COLUMNS = [f.name for f in S.PUSH_JOB.fields]


def job_id(sku: Column, platform: Column, batch: Column) -> Column:
    return F.xxhash64(sku, platform, batch).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def empty_jobs(spark) -> DataFrame:
    return spark.createDataFrame([], S.PUSH_JOB)


def owed_targets(applied: DataFrame) -> DataFrame:
    """AGG-3 + JN-15: latest target per (sku, platform) of push-eligible sales.

    Aggregated per SKU first (partial/final ``max_by``), then fanned out to
    the two platforms, so the fan-out multiplies SKUs, not sales.
    """
    per_sku = (
        applied.filter(F.col("push_eligible"))
        .groupBy("internal_sku")
        .agg(F.max_by("after_units", "seq").alias("target_quantity"),
             F.count("*").alias("n_sales"))
    )
    return per_sku.select(
        "internal_sku", F.explode(F.array(*[F.lit(p) for p in S.PLATFORMS])).alias("platform"),
        "target_quantity", "n_sales",
    )


def enqueue(jobs: DataFrame, targets: DataFrame, batch_id: int, now_ms: int,
            max_attempts: int = S.PUSH_MAX_ATTEMPTS) -> DataFrame:
    """STA-1: a pending job takes the new target (keeps attempts and due
    time); any other pair gets a new pending job due ``now_ms``. Only pending
    jobs coalesce: a dead-lettered or finished job stays as it is."""
    jobs = jobs.select(*JOB_COLUMNS)
    pending = jobs.filter(F.col("status") == "pending")
    others = jobs.filter(F.col("status") != "pending")
    t = targets.select(*PAIR, F.col("target_quantity").alias("_new_target"))
    merged = pending.join(t, PAIR, "full_outer")
    is_new = F.col("job_id").isNull()
    out = merged.select(
        F.when(is_new, job_id(F.col("internal_sku"), F.col("platform"), F.lit(batch_id)))
        .otherwise(F.col("job_id")).alias("job_id"),
        "internal_sku", "platform",
        F.coalesce("_new_target", "target_quantity").cast("long").alias("target_quantity"),
        F.lit("pending").alias("status"),
        F.when(is_new, F.lit(0)).otherwise(F.col("attempts")).cast("long").alias("attempts"),
        F.when(is_new, F.lit(max_attempts)).otherwise(F.col("max_attempts")).cast("long").alias("max_attempts"),
        F.when(is_new, F.lit(now_ms)).otherwise(F.col("next_attempt_at")).cast("long").alias("next_attempt_at"),
        F.when(is_new, F.lit(None)).otherwise(F.col("last_error")).cast("string").alias("last_error"),
        F.when(is_new, F.lit(batch_id)).otherwise(F.col("created_batch")).cast("long").alias("created_batch"),
    )
    return others.unionByName(out)


def due(jobs: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """FLT-3 (+ SRT-1): pending jobs whose due time has passed, oldest first."""
    d = jobs.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now_ms)))
    if limit is not None:
        d = d.orderBy("next_attempt_at", "internal_sku", "platform", "job_id").limit(limit)
    return d


def _pow2(n: Column) -> Column:
    """``1 << n`` on longs (exact backoff arithmetic)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _has(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def skip_reason(jobs: DataFrame, mapping: DataFrame, push_enabled: bool = True,
                default_location: str | None = None) -> DataFrame:
    """FLT-7: why a job cannot be delivered (null = deliverable), plus the route.

    First failing reason wins: switch, mapping, route. The mapping has one row
    per SKU and meets the jobs by key.
    """
    m = mapping.select(
        "internal_sku", F.lit(True).alias("_has_mapping"),
        "shopify_inventory_item_id", "shopify_location_id", "etsy_listing_id", "etsy_offering_id")
    j = jobs.join(by_key(m), "internal_sku", "left")
    loc_ok = _has(F.col("shopify_location_id")) | F.lit(bool(default_location))
    shop_ok = _has(F.col("shopify_inventory_item_id")) & loc_ok
    etsy_ok = _has(F.col("etsy_listing_id")) & _has(F.col("etsy_offering_id"))
    reason = (
        F.when(F.lit(not push_enabled), F.lit(S.SKIP_PUSH_DISABLED))
        .when(F.col("_has_mapping").isNull(), F.lit(S.SKIP_NO_MAPPING))
        .when((F.col("platform") == "shopify") & ~shop_ok, F.lit(S.SKIP_SHOPIFY_ROUTE))
        .when((F.col("platform") == "etsy") & ~etsy_ok, F.lit(S.SKIP_ETSY_ROUTE))
    )
    location = F.coalesce(F.nullif(F.col("shopify_location_id"), F.lit("")), F.lit(default_location).cast("string"))
    return j.select(
        *[F.col(c) for c in jobs.columns], reason.alias("skip_reason"),
        F.when(F.col("platform") == "shopify", F.col("shopify_inventory_item_id"))
        .otherwise(F.col("etsy_listing_id")).alias("route_id"),
        F.when(F.col("platform") == "shopify", location).otherwise(F.col("etsy_offering_id")).alias("route_sub_id"),
    )


def payload(c_platform: Column, route_id: Column, route_sub: Column, qty: Column) -> Column:
    """PRJ-19: the absolute-set request body of each platform, as JSON text.
    An id that is no number is sent as null; the platform refuses it, and the other jobs go on."""
    whole = {"ignoreNullFields": "false"}
    shop = F.to_json(F.struct(route_id.try_cast("long").alias("inventory_item_id"), route_sub.try_cast("long").alias("location_id"),
                              qty.alias("available")), whole)
    etsy = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(
        route_sub.try_cast("long").alias("offering_id"), qty.alias("quantity"),
        F.lit(True).alias("is_enabled"))).alias("offerings"))).alias("products")), whole)
    return F.when(c_platform == "shopify", shop).otherwise(etsy)


def deliver(routed: DataFrame, sink: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """SNK-9: call a user sink for every deliverable job, one Arrow batch at a time.

    ``sink`` gets a pandas frame ``(job_id, internal_sku, platform,
    target_quantity, route_id, route_sub_id, body)`` and returns
    ``(job_id, ok, error)``. Only the transport is opaque; the state change
    stays in :func:`transition`. The sink sets an absolute quantity, so a
    repeat after a task retry is harmless (at-least-once transport).
    """
    todo = routed.filter(F.col("skip_reason").isNull()).select(
        "job_id", "internal_sku", "platform", "target_quantity", "route_id", "route_sub_id",
        payload(F.col("platform"), F.col("route_id"), F.col("route_sub_id"),
                F.col("target_quantity")).alias("body"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield sink(pdf)[["job_id", "ok", "error"]]

    return todo.mapInPandas(run, schema=S.ATTEMPT_RESULT)


def transition(jobs_due: DataFrame, results: DataFrame, now_ms: int,
               retry_base_ms: int = S.PUSH_RETRY_BASE_MS) -> DataFrame:
    """STA-2: one attempt for each due job -> its new state and attempt log.

    ``jobs_due`` carries ``skip_reason``; ``results`` is ``(job_id, ok,
    error)`` for the delivered ones. Attempts grow by one in every case,
    including a skip; success clears ``last_error``; backoff is
    ``base * 2^(attempts-1)`` in exact long arithmetic.
    """
    r = results.select("job_id", F.col("ok").alias("_ok"), F.col("error").alias("_err"))
    j = jobs_due.join(by_key(r), "job_id", "left")
    att = (F.col("attempts") + 1).cast("long")
    skipped = F.col("skip_reason").isNotNull()
    ok = ~skipped & F.coalesce(F.col("_ok"), F.lit(False))
    err = F.coalesce(F.col("_err"), F.lit("no delivery result"))
    dead = ~skipped & ~ok & (att >= F.col("max_attempts"))
    delay = F.lit(retry_base_ms).cast("long") * _pow2(att - 1)
    outcome = (F.when(skipped, F.lit("skipped")).when(ok, F.lit("succeeded"))
               .when(dead, F.lit("dead_letter")).otherwise(F.lit("retry_scheduled")))
    status = (F.when(skipped, F.lit("skipped")).when(ok, F.lit("succeeded"))
              .when(dead, F.lit("dead_letter")).otherwise(F.lit("pending")))
    log_status = F.when(skipped, F.lit("skipped")).when(ok, F.lit("success")).otherwise(F.lit("failed"))
    message = (
        F.when(skipped, F.col("skip_reason"))
        .when(ok, F.format_string(S.LOG_SUCCESS_FORMAT, F.col("platform"), att))
        .when(dead, F.format_string(S.LOG_DEAD_FORMAT, att, err))
        .otherwise(F.format_string(S.LOG_RETRY_FORMAT, att, delay, err))
    )
    return j.select(
        "job_id", "internal_sku", "platform", "target_quantity",
        status.alias("status"), att.alias("attempts"), "max_attempts",
        F.when(outcome == "retry_scheduled", F.lit(now_ms) + delay)
        .otherwise(F.col("next_attempt_at")).cast("long").alias("next_attempt_at"),
        F.when(skipped, F.col("skip_reason")).when(ok, F.lit(None).cast("string"))
        .otherwise(err).alias("last_error"),
        "created_batch",
        outcome.alias("outcome"), log_status.alias("log_status"), message.alias("message"),
    )


def apply_round(jobs: DataFrame, transitioned: DataFrame) -> DataFrame:
    """New outbox version: transitioned jobs replace their old rows."""
    changed = transitioned.select(*JOB_COLUMNS)
    return jobs.select(*JOB_COLUMNS).join(by_key(changed.select("job_id")), "job_id", "left_anti").unionByName(changed)


def dispatch_round(jobs: DataFrame, mapping: DataFrame, results_fn, now_ms: int, limit: int | None = None,
                   push_enabled: bool = True, default_location: str | None = None,
                   retry_base_ms: int = S.PUSH_RETRY_BASE_MS) -> tuple[DataFrame, DataFrame]:
    """STA-3: due jobs -> route check -> delivery -> transition.

    ``results_fn(routed) -> (job_id, ok, error)``: :func:`deliver` with a
    sink, or a fixture. Returns ``(new jobs version, transitions)``.
    """
    d = due(jobs, now_ms, limit)
    routed = skip_reason(d, mapping, push_enabled, default_location)
    tr = transition(routed, results_fn(routed), now_ms, retry_base_ms)
    return apply_round(jobs, tr), tr


def claim(jobs: DataFrame, now_ms: int, lease_ms: int = S.CLAIM_LEASE_MS,
          limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """STA-5: lease due pending jobs by moving their due time ``lease_ms`` ahead.

    Returns ``(claimed jobs, new jobs version)``. An expired lease is simply
    due again. One writer per outbox version, so the claim needs no race
    arbitration.
    """
    d = due(jobs, now_ms, limit).select("job_id").withColumn("_claimed", F.lit(True))
    j = jobs.select(*JOB_COLUMNS).join(by_key(d), "job_id", "left")
    claimed = F.coalesce(F.col("_claimed"), F.lit(False))
    new = j.select(
        *[F.when(claimed, F.lit(now_ms + lease_ms)).otherwise(F.col(c)).cast("long").alias(c)
          if c == "next_attempt_at" else F.col(c) for c in JOB_COLUMNS],
        claimed.alias("claimed"),
    )
    return new.filter("claimed").drop("claimed"), new.drop("claimed")


def release(jobs: DataFrame, job_ids: DataFrame, now_ms: int) -> DataFrame:
    """STA-5 release: a failed publish makes the job due again at ``now_ms``."""
    ids = job_ids.select("job_id").withColumn("_rel", F.lit(True))
    j = jobs.select(*JOB_COLUMNS).join(by_key(ids), "job_id", "left")
    back = F.col("_rel") & (F.col("status") == "pending")
    return j.select(*[F.when(back, F.lit(now_ms)).otherwise(F.col(c)).cast("long").alias(c)
                      if c == "next_attempt_at" else F.col(c) for c in JOB_COLUMNS])


def requeue(jobs: DataFrame, job_ids: DataFrame, now_ms: int) -> DataFrame:
    """STA-4: dead letters among ``job_ids`` -> pending, attempts 0, due now,
    error cleared, target unchanged. Other ids (or unknown ones) are no-ops."""
    ids = job_ids.select("job_id").distinct().withColumn("_req", F.lit(True))
    j = jobs.select(*JOB_COLUMNS).join(by_key(ids), "job_id", "left")
    hit = F.coalesce(F.col("_req"), F.lit(False)) & (F.col("status") == "dead_letter")
    repl = {
        "status": F.lit("pending"), "attempts": F.lit(0).cast("long"),
        "next_attempt_at": F.lit(now_ms).cast("long"), "last_error": F.lit(None).cast("string"),
    }
    return j.select(*[F.when(hit, repl[c]).otherwise(F.col(c)).alias(c) if c in repl else F.col(c)
                      for c in JOB_COLUMNS])


def attempt_history(jobs: DataFrame, routed_ok: DataFrame, start_ms_col: str = "next_attempt_at",
                    retry_base_ms: int = S.PUSH_RETRY_BASE_MS) -> DataFrame:
    """WIN-8: every attempt of each job when the dispatcher runs at each due time.

    ``routed_ok`` has ``(job_id, skip_reason, attempt_no, ok, error)`` for
    attempts 1..max_attempts (a fixture or a replayed log). Only pending jobs
    are attempted, from the attempt after those already used (``attempts``,
    default 0). The first success (or the last allowed attempt) is terminal;
    attempt k runs at ``start + base * (2^(k-1) - 2^used)``.
    """
    used = F.col("attempts") if "attempts" in jobs.columns else F.lit(0)
    open_ = jobs.filter(F.col("status") == "pending") if "status" in jobs.columns else jobs
    a = open_.select("job_id", "internal_sku", "platform", "max_attempts", start_ms_col, used.cast("long").alias("_used")).join(
        by_key(routed_ok), "job_id").filter(F.col("attempt_no").between(F.col("_used") + 1, F.col("max_attempts")))
    first_ok = F.min(F.when(F.col("ok") | F.col("skip_reason").isNotNull(), F.col("attempt_no"))).over(
        Window.partitionBy("job_id"))
    a = a.withColumn("_terminal", F.coalesce(first_ok, F.col("max_attempts")))
    a = a.filter(F.col("attempt_no") <= F.col("_terminal"))
    k = F.col("attempt_no").cast("long")
    at = F.col(start_ms_col) + F.lit(retry_base_ms) * (_pow2(k - 1) - _pow2(F.col("_used")))
    skipped = F.col("skip_reason").isNotNull()
    dead = ~skipped & ~F.col("ok") & (k >= F.col("max_attempts"))
    outcome = (F.when(skipped, F.lit("skipped")).when(F.col("ok"), F.lit("succeeded"))
               .when(dead, F.lit("dead_letter")).otherwise(F.lit("retry_scheduled")))
    delay = F.lit(retry_base_ms) * _pow2(k - 1)
    message = (
        F.when(skipped, F.col("skip_reason"))
        .when(F.col("ok"), F.format_string(S.LOG_SUCCESS_FORMAT, F.col("platform"), k))
        .when(dead, F.format_string(S.LOG_DEAD_FORMAT, k, F.col("error")))
        .otherwise(F.format_string(S.LOG_RETRY_FORMAT, k, delay, F.col("error")))
    )
    return a.select("job_id", "internal_sku", "platform", k.alias("attempt_no"), at.alias("attempt_at"),
                    outcome.alias("outcome"), message.alias("message"),
                    F.when(~skipped & ~F.col("ok"), F.col("error")).alias("error"))


def number_attempts(log: DataFrame, keys: list[str], order: str, max_attempts: int = S.PUSH_MAX_ATTEMPTS,
                    retry_base_ms: int = S.PUSH_RETRY_BASE_MS, materialize=None) -> DataFrame:
    """WIN-8 / SNK-3: a landed attempt log, numbered.

    ``log`` has ``keys`` (the job), ``order`` (a total order inside a job),
    ``platform``, ``kind`` (``attempt``, or ``requeue`` where a requeue took
    effect), ``ok``, ``skip_reason`` and ``error``. A marker opens an
    ``epoch``, in which attempts count from 1; the first success, skip or last
    allowed failure ends it. Attempts after that should not have been made:
    they keep their number and are ``superfluous``.

    Running counts come from ordered scans over one set of chunks, so a job
    with any number of attempts spans as many tasks as its rows need."""
    cols = log.columns
    attempt = F.col("kind") == "attempt"
    rows = ordered_scan(log, keys, order, sums={"epoch": F.when(attempt, 0).otherwise(1), "_made": F.when(attempt, 1).otherwise(0)}, materialize=materialize)
    rows = ordered_scan(rows, keys, order, last_before={"_start": F.when(~attempt, F.struct(F.col("_made").alias("n")))})
    rows = rows.withColumn("attempt_no", (F.col("_made") - F.coalesce(F.col("_start.n"), F.lit(0))).cast("long"))
    skipped, k = F.col("skip_reason").isNotNull(), F.col("attempt_no")
    dead = ~skipped & ~F.col("ok") & (k >= max_attempts)
    ends = attempt & (skipped | F.col("ok") | dead)
    rows = ordered_scan(rows, keys, order, sums={"_ended": F.when(ends, 1).otherwise(0)})
    rows = ordered_scan(rows, keys, order, last_before={"_closed": F.when(~attempt, F.struct(F.col("_ended").alias("n")))})
    earlier = F.col("_ended") - F.when(ends, 1).otherwise(0) - F.coalesce(F.col("_closed.n"), F.lit(0))
    outcome = (F.when(skipped, F.lit("skipped")).when(F.col("ok"), F.lit("succeeded"))
               .when(dead, F.lit("dead_letter")).otherwise(F.lit("retry_scheduled")))
    # Numbers beyond the limit are superfluous; their delay is that of the last allowed.
    delay = F.lit(retry_base_ms) * _pow2(F.least(k, F.lit(max_attempts)) - 1)
    message = (
        F.when(skipped, F.col("skip_reason"))
        .when(F.col("ok"), F.format_string(S.LOG_SUCCESS_FORMAT, F.col("platform"), k))
        .when(dead, F.format_string(S.LOG_DEAD_FORMAT, k, F.col("error")))
        .otherwise(F.format_string(S.LOG_RETRY_FORMAT, k, delay, F.col("error"))))
    return rows.where(attempt).select(*cols, F.col("epoch").cast("long").alias("epoch"), "attempt_no", outcome.alias("outcome"),
                                      message.alias("message"), (earlier > 0).alias("superfluous"))


def jobs_after_history(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Job table after its whole attempt history (last attempt per job)."""
    last = history.groupBy("job_id").agg(F.max_by(F.struct("attempt_no", "attempt_at", "outcome", "message",
                                                           "error"),
                                                  "attempt_no").alias("_h"))
    j = jobs.select(*JOB_COLUMNS).join(by_key(last), "job_id", "left")
    h = F.col("_h")
    outcome = h["outcome"]
    status = (F.when(h.isNull(), F.col("status")).when(outcome == "retry_scheduled", F.lit("pending"))
              .otherwise(outcome))
    err = F.when(outcome == "succeeded", F.lit(None).cast("string")).when(
        outcome == "skipped", h["message"]).otherwise(h["error"])
    return j.select(
        "job_id", "internal_sku", "platform", "target_quantity", status.alias("status"),
        F.coalesce(h["attempt_no"].cast("long"), F.col("attempts")).alias("attempts"), "max_attempts",
        F.coalesce(h["attempt_at"], F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(h.isNull(), F.col("last_error")).otherwise(err).alias("last_error"),
        "created_batch",
    )


def dead_letters(jobs: DataFrame) -> DataFrame:
    """FLT-4 (+ SRT-4 by the caller): dead-lettered jobs."""
    return jobs.filter(F.col("status") == "dead_letter")
