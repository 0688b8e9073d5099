"""Registered queries over tables with a history: relay rounds with refused
messages, the write-back consumer with its attempt log, lines resolved with the
mapping of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.operators import mapping_versions, outbox
from stockflow.plans import catalogue
from stockflow.sources import testdata as TD
from stockflow.store import TableStore, by_key, materialize, scratch_root
from stockflow.streaming import writeback

NOW_MS = TD.NOW_MS


def _outbox(spark: SparkSession, sf_dir: str, name: str, max_attempts: int = S.PUSH_MAX_ATTEMPTS) -> tuple[str, TableStore, TableStore]:
    """A fresh outbox that owes the targets of the whole ledger, and a consumer without history."""
    root = scratch_root(spark, name)
    store, consumer = TableStore(spark, f"{root}/outbox"), TableStore(spark, f"{root}/consumer")
    targets = outbox.owed_targets(catalogue._ingested(spark, sf_dir).applied)
    writeback.enqueue(store, consumer, targets, 1, NOW_MS, max_attempts)
    return root, store, consumer


def relay_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-5/STR-4: three relay rounds. The topic refuses parts p%5=2 in the
    first and p%10=7 in the second, two seconds later, which takes up only
    what was released; in the third the leases of the first have run out."""
    root, store, consumer = _outbox(spark, sf_dir, "release")
    p = TD.partkey_of(F.col("key"))
    for i, (at, accepts) in enumerate(((0, p % 5 != 2), (2000, p % 10 != 7), (30_000, None))):
        writeback.relay_round(store, consumer, 2 + 2 * i, NOW_MS + at, writeback.to_folder(f"{root}/topic", accepts))
    return store.read("relayed").select("internal_sku", "platform", "target_quantity", "accepted", "sent_at", "due_at")


def writeback_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5/SNK-3: the attempt log of a consumer that is stopped and started
    again: all jobs are relayed and attempted, then those due for their retry."""
    root, store, consumer = _outbox(spark, sf_dir, "writeback")
    for i, at in enumerate((0, 5000)):
        writeback.relay_round(store, consumer, 2 + 2 * i, NOW_MS + at, writeback.to_folder(f"{root}/topic"))
        writeback.start(spark, f"{root}/topic", f"{root}/checkpoint", store, consumer, TD.outbox_mapping(spark, sf_dir), TD.fixture_results,
                        NOW_MS + at).awaitTermination()
    return consumer.read("attempts").select("internal_sku", "platform", "target_quantity", "attempt_no", "attempt_at", "outcome", "message")


REQUEUED_AT = NOW_MS + 3_600_000


def _requeued(spark: SparkSession, sf_dir: str) -> tuple[TableStore, TableStore]:
    """A durable outbox with two attempts a job: what fails twice is dead; the
    dead letters of even parts are requeued an hour later and delivered to a
    platform that has recovered."""

    def build() -> tuple[TableStore, TableStore]:
        root, store, consumer = _outbox(spark, sf_dir, "requeued", max_attempts=2)
        mapping = TD.outbox_mapping(spark, sf_dir)

        def deliver_due(number: int, now_ms: int, results_fn) -> None:
            writeback.relay_round(store, consumer, number, now_ms, writeback.to_folder(f"{root}/topic"))
            writeback.start(spark, f"{root}/topic", f"{root}/checkpoint", store, consumer, mapping, results_fn, now_ms).awaitTermination()

        deliver_due(2, NOW_MS, TD.fixture_results)
        deliver_due(4, NOW_MS + 5000, TD.fixture_results)
        jobs = writeback.current_jobs(store, consumer, REQUEUED_AT)
        writeback.requeue(store, consumer, jobs.where(TD.partkey_of(F.col("internal_sku")) % 2 == 0), 6, REQUEUED_AT)
        deliver_due(8, REQUEUED_AT, lambda routed: TD.fixture_results(routed).select("job_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
        return store, consumer

    return catalogue._cached(spark, sf_dir, "requeued", build)


def writeback_requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-4/WIN-8/SNK-3: the durable attempt log, cut into epochs by the requeues."""
    return writeback.attempt_epochs(*_requeued(spark, sf_dir)).select(
        "internal_sku", "platform", "epoch", "attempt_no", "attempt_at", "outcome", "message")


def writeback_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4/FLT-12/AGG-10: every job of the durable outbox as its consumer left
    it, beside what the attempt log says of it: attempts, deliveries, requeues."""
    store, consumer = _requeued(spark, sf_dir)
    jobs = writeback.current_jobs(store, consumer, REQUEUED_AT)
    told = consumer.read("attempts").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col("outcome") == "succeeded").alias("n_delivered"))
    marks = store.read("requeued").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_requeued"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_attempts", "n_delivered", "n_requeued")]
    return jobs.join(by_key(told), "job_id", "left").join(by_key(marks), "job_id", "left").select(
        "internal_sku", "platform", "target_quantity", "status", "attempts", "last_error", *counts)


def sku_resolution_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1..4/STA-7: every delivered line with the SKU its mapping named when
    it happened; parts are imported late and keys move between them."""
    lines = TD.lines(spark, sf_dir).select("platform", "external_event_id", "arrival", "seq", "platform_sku", "variant_id")
    return mapping_versions.resolve_as_of(lines, TD.mapping_versions(spark, sf_dir), materialize).select(
        "platform", "external_event_id", F.col("arrival.batch").alias("delivery"), *catalogue._seq_cols(), "platform_sku", "variant_id", "internal_sku")


QUERIES = {
    "sku_resolution_as_of": sku_resolution_as_of,
    "relay_release": relay_release,
    "writeback_attempts": writeback_attempts,
    "writeback_requeued": writeback_requeued,
    "writeback_jobs": writeback_jobs,
}
