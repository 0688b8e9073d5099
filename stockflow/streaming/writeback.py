"""STA-5 / STR-4 / STR-5 / SNK-3 on durable tables: relay and write-back
consumer, each with its own published tables.

* The outbox (``jobs``) is changed by :func:`enqueue` and :func:`relay_round`.
  A round commits its leases before it sends, then joins the outcome of every
  message back: a refused one is due again at once. A relay that dies in
  between leaves leases that run out, so nothing is stranded.
* The consumer publishes, under the id of its micro-batch, what became of each
  message (by its place in the topic), the attempt log and the states of the
  jobs it attempted. A micro-batch that is repeated after a crash finds its id
  published, or its half-written tables invisible, and takes effect once.
* The two meet by :func:`overlay`: the consumer's states that the outbox has
  not folded in yet count. A target that changed while an older one was being
  delivered leaves the job pending with the new target.

Messages are not trusted beyond their job id; the target is the job's. The
transport sets absolute quantities, so a repeated call does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.operators import outbox
from stockflow.operators.scan import ordered_scan
from stockflow.store import TableStore, by_key, materialize, scratch
from stockflow.streaming import relay

#: (messages with job_id, key, value) -> (job_id, ok)
Send = Callable[[DataFrame], DataFrame]


def overlay(jobs: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """``jobs`` as the later ``states`` of the consumer leave them.

    A state whose target is not the job's any more was reached with an older
    target: a finished job is then owed again (no attempts, due at ``now_ms``)
    and a pending one keeps the new target."""
    kept = ["status", "attempts", "next_attempt_at", "last_error"]
    j = jobs.join(by_key(states.select("job_id", F.struct("target_quantity", *kept).alias("_s"))), "job_id", "left")
    s, hit = F.col("_s"), F.col("_s").isNotNull()
    reopened = hit & (s["status"] != "pending") & ~s["target_quantity"].eqNullSafe(F.col("target_quantity"))
    anew = {"status": F.lit("pending"), "attempts": F.lit(0).cast("long"), "next_attempt_at": F.lit(now_ms).cast("long"),
            "last_error": F.lit(None).cast("string")}
    return j.select(*[F.when(reopened, anew[c]).when(hit, s[c]).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in outbox.JOB_COLUMNS])


def _later_states(consumer: TableStore, folded: int, m: dict) -> DataFrame | None:
    path = consumer.path("states", m)
    return None if path is None else consumer.spark.read.parquet(path).where(F.col("micro_batch") > folded)


def _folded(store: TableStore) -> int:
    """The last micro-batch of the consumer that the outbox holds."""
    row = store.read("folded").first()
    return row.micro_batch


def current_jobs(store: TableStore, consumer: TableStore, now_ms: int, m: dict | None = None) -> DataFrame:
    """The outbox with all that the consumer has published (as of its manifest ``m``)."""
    later = _later_states(consumer, _folded(store), m or consumer.manifest())
    jobs = store.read("jobs")
    return jobs if later is None else overlay(jobs, later, now_ms)


def _publish(store: TableStore, number: int, jobs: DataFrame, folded: int, append: dict | None = None) -> bool:
    mark = store.spark.range(1).select(F.lit(folded).cast("long").alias("micro_batch"))
    return store.publish(number, state={"jobs": jobs, "folded": mark}, append=append)


def enqueue(store: TableStore, consumer: TableStore, targets: DataFrame, number: int, now_ms: int, max_attempts: int = S.PUSH_MAX_ATTEMPTS) -> bool:
    """STA-1 on the durable outbox, published as ``number``."""
    if number <= store.manifest()["last_batch"]:
        return False
    m = consumer.manifest()
    jobs = current_jobs(store, consumer, now_ms, m) if store.path("jobs") else outbox.empty_jobs(store.spark)
    return _publish(store, number, outbox.enqueue(jobs, targets, number, now_ms, max_attempts), m["last_batch"])


def to_folder(path: str, accepts: Column | None = None) -> Send:
    """Messages to a topic folder, a SKU's in one file; those that do not
    satisfy ``accepts`` (over job_id, key, value) are refused."""

    def send(messages: DataFrame) -> DataFrame:
        told = messages.withColumn("ok", F.lit(True) if accepts is None else F.coalesce(accepts, F.lit(False)))
        told.where("ok").select("key", "value").repartition("key").write.mode("append").parquet(path)
        return told.select("job_id", "ok")

    return send


@scratch()
def relay_round(store: TableStore, consumer: TableStore, number: int, now_ms: int, send: Send, lease_ms: int = S.CLAIM_LEASE_MS,
                limit: int | None = None) -> bool:
    """STR-4 / STA-5: lease the due jobs (published as ``number``), send their
    messages, release what was not accepted (published as ``number + 1``).

    Table ``relayed`` tells for every message whether it was accepted and when
    its job is due again. A round whose leases were published is not run again."""
    if number <= store.manifest()["last_batch"]:
        return False
    m = consumer.manifest()
    claimed, leased = outbox.claim(materialize(current_jobs(store, consumer, now_ms, m)), now_ms, lease_ms, limit)
    claimed = materialize(claimed)
    _publish(store, number, leased, m["last_batch"])
    messages = relay.encode_events(claimed, keep=["job_id"])
    accepted = materialize(send(messages).where("ok").select("job_id").distinct())
    told = materialize(claimed.select("job_id", "internal_sku", "platform", "target_quantity").join(
        by_key(accepted.withColumn("accepted", F.lit(True))), "job_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))))
    jobs = outbox.release(store.read("jobs"), told.where("NOT accepted"), now_ms)
    log = told.withColumn("sent_at", F.lit(now_ms).cast("long")).withColumn(
        "due_at", F.when(F.col("accepted"), F.lit(now_ms + lease_ms)).otherwise(F.lit(now_ms)).cast("long"))
    return _publish(store, number + 1, jobs, m["last_batch"], {"relayed": log})


@scratch()
def requeue(store: TableStore, consumer: TableStore, job_ids: DataFrame, number: int, now_ms: int) -> bool:
    """STA-4 on the durable outbox: the dead letters among ``job_ids`` are owed
    again, published as ``number``; other ids change nothing.

    Table ``requeued`` keeps a marker for each, so that the attempt log can be
    cut into epochs (:func:`attempt_epochs`)."""
    if number <= store.manifest()["last_batch"]:
        return False
    m = consumer.manifest()
    jobs = materialize(current_jobs(store, consumer, now_ms, m))
    hit = jobs.where("status = 'dead_letter'").join(by_key(job_ids.select("job_id").distinct()), "job_id", "left_semi")
    marks = hit.select("job_id", F.lit(now_ms).cast("long").alias("requeued_at"), F.lit(m["last_batch"]).cast("long").alias("after_batch"))
    return _publish(store, number, outbox.requeue(jobs, job_ids, now_ms), m["last_batch"], {"requeued": marks})


def attempt_epochs(store: TableStore, consumer: TableStore) -> DataFrame:
    """The consumer's attempt log with the ``epoch`` of each attempt: the number
    of requeues that the job had seen before it (0: none).

    A requeue comes after the attempts of the micro-batches that it knew of and
    before all later ones, whatever the clocks said; a job has one attempt per
    micro-batch. The running count comes from one ordered scan, so a job with
    any number of attempts is no hot task."""
    marks = store.read("requeued")
    log = consumer.read("attempts").drop("batch_id")
    place = lambda batch, mark: F.struct(batch.alias("batch"), F.lit(mark).alias("mark")).alias("_at")
    rows = consumer.read("attempts").select(*log.columns, place(F.col("batch_id").cast("long"), 0), F.lit(0).alias("_mark"))
    if marks is not None:
        rows = rows.unionByName(marks.select("job_id", place(F.col("after_batch"), 1), F.lit(1).alias("_mark")), allowMissingColumns=True)
    rows = ordered_scan(materialize(rows), ["job_id"], "_at", sums={"epoch": F.col("_mark")}, materialize=materialize)
    return rows.where("_mark = 0").select(*log.columns, F.col("epoch").cast("long").alias("epoch"))


def message_fates(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """What becomes of each message (FLT-14 / JN-11), by place in the topic:
    ``undecodable``, ``unknown_job``, ``not_pending``, ``repeated`` (a later
    one of a job in the micro-batch) or ``attempted``; ``stale`` where it names
    another target than its job."""
    place = F.struct("topic_file", "topic_pos")
    first = events.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.min(place).alias("_first"))
    known = jobs.join(by_key(first), "job_id").select("job_id", F.col("status").alias("_status"), F.col("target_quantity").alias("_target"), "_first")
    bad, of = events.where(F.col("job_id").isNull()), events.where(F.col("job_id").isNotNull())
    fate = (F.when(F.col("_status").isNull(), F.lit("unknown_job")).when(F.col("_status") != "pending", F.lit("not_pending"))
            .when(place == F.col("_first"), F.lit("attempted")).otherwise(F.lit("repeated")))
    cols = ["topic_file", "topic_pos", "key", "job_id"]
    told = of.join(by_key(known), "job_id", "left").select(*cols, fate.alias("fate"), F.coalesce(F.col("target_quantity") != F.col("_target"), F.lit(False)).alias("stale"))
    return told.unionByName(bad.select(*cols, F.lit("undecodable").alias("fate"), F.lit(False).alias("stale")))


@scratch()
def process(store: TableStore, consumer: TableStore, batch: DataFrame, batch_id: int, mapping: DataFrame, results_fn, now_ms: int,
            retry_base_ms: int = S.PUSH_RETRY_BASE_MS) -> bool:
    """One micro-batch of messages, published by the consumer as ``batch_id``."""
    m = consumer.manifest()
    if batch_id <= m["last_batch"]:
        return False
    folded = _folded(store)
    jobs = materialize(current_jobs(store, consumer, now_ms, m))
    events = materialize(relay.parse_events(batch))
    fates = materialize(message_fates(events, jobs))
    todo = jobs.join(by_key(fates.where("fate = 'attempted'").select("job_id")), "job_id", "left_semi")
    routed = outbox.skip_reason(todo, mapping)
    moved = materialize(outbox.transition(routed, results_fn(routed), now_ms, retry_base_ms))
    states = moved.select(*outbox.JOB_COLUMNS, F.lit(batch_id).cast("long").alias("micro_batch"))
    earlier = _later_states(consumer, folded, m)
    if earlier is not None:
        states = states.unionByName(earlier.join(by_key(moved.select("job_id")), "job_id", "left_anti"))
    log = moved.select("job_id", "internal_sku", "platform", "target_quantity", F.col("attempts").alias("attempt_no"),
                       F.lit(now_ms).cast("long").alias("attempt_at"), "outcome", "log_status", "message")
    return consumer.publish(batch_id, state={"states": states}, append={"attempts": log, "messages": fates})


def start(spark: SparkSession, topic_path: str, checkpoint: str, store: TableStore, consumer: TableStore, mapping: DataFrame, results_fn,
          now_ms: int, files_per_trigger: int | None = None, available_now: bool = True):
    """Start the consumer; a restart goes on where its checkpoint ends."""
    reader = spark.readStream.schema("key string, value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    placed = reader.parquet(topic_path).select("key", "value", F.col("_metadata.file_name").alias("topic_file"), F.col("_metadata.row_index").alias("topic_pos"))
    writer = placed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: process(store, consumer, df, i, mapping, results_fn, now_ms) and None)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()
