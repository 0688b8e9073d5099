"""Outbox relay and topic consumers (STR-4..7, SNK-8, PRJ-21).

Messages are ``(key, value)`` rows: key = internal SKU (so a hash-partitioned
topic keeps per-SKU order), value = JSON ``{job_id, internal_sku, platform,
target_quantity}``. With a Kafka package on the classpath the same frame is
written with ``format("kafka")``; here the topic is a directory of parquet
files read as a file stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow import schemas as S


def encode_events(jobs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SNK-8 / PRJ-21 encode; columns of ``keep`` stay beside the message."""
    return jobs.select(
        *(keep or []),
        F.col("internal_sku").alias("key"),
        F.to_json(F.struct("job_id", "internal_sku", "platform", "target_quantity")).alias("value"))


def parse_events(messages: DataFrame) -> DataFrame:
    """``messages`` without the text and with the event's columns, all null
    where it cannot be decoded (missing fields -> 0 / '')."""
    schema = T.StructType([*S.STOCK_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    d = messages.withColumn("_e", F.from_json(F.col("value").cast("string"), schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("_e").isNotNull() & F.col("_e._corrupt").isNull()
    missing = {"string": F.lit(""), "bigint": F.lit(0)}
    return d.select(*[c for c in messages.columns if c != "value"], *[
        F.when(good, F.coalesce(F.col("_e")[f.name], missing[f.dataType.simpleString()]).cast(f.dataType)).alias(f.name) for f in S.STOCK_EVENT.fields])


def decode_events(messages: DataFrame) -> DataFrame:
    """PRJ-21 decode; undecodable messages are dropped."""
    return parse_events(messages.select("key", "value")).where(F.col("job_id").isNotNull())


def consumable(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-11 / FLT-14: events whose job exists and is still pending.

    Repeats of one job id inside a micro-batch collapse to one attempt.
    """
    ev = events.select("job_id").distinct()
    return jobs.join(ev, "job_id", "left_semi").filter(F.col("status") == "pending")


def relay_once(jobs: DataFrame, now_ms: int, topic_path: str, lease_ms: int = S.CLAIM_LEASE_MS,
               limit: int | None = None) -> DataFrame:
    """STR-4: claim due jobs, publish their events keyed by SKU, return the
    new jobs version. Messages are hash-partitioned by key so one SKU's
    events stay in one partition file, in order."""
    from stockflow.operators import outbox

    claimed, new_jobs = outbox.claim(jobs, now_ms, lease_ms, limit)
    msgs = encode_events(claimed).repartition(F.col("key"))
    msgs.write.mode("append").parquet(topic_path)
    return new_jobs


def start_consumer(spark, topic_path: str, checkpoint: str, handler, available_now: bool = True):
    """SRC-5/STR-5/STR-6: one consumer group = one streaming query with its
    own checkpoint; a new group starts from the earliest message."""
    schema = "key string, value string"
    stream = spark.readStream.schema(schema).parquet(topic_path)
    w = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")
    return w.start()


class WritebackConsumer:
    """STR-5 handler: decode, re-read the job, skip if not pending, attempt.

    The job table is the state; every micro-batch produces its next version
    (materialised), so a redelivered message finds its job already final.
    """

    def __init__(self, jobs: DataFrame, mapping: DataFrame, results_fn, now_ms: int,
                 retry_base_ms: int = S.PUSH_RETRY_BASE_MS):
        self.jobs = jobs
        self.mapping = mapping
        self.results_fn = results_fn
        self.now_ms = now_ms
        self.retry_base_ms = retry_base_ms
        self.transitions = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from stockflow.operators import outbox
        from stockflow.store import checkpointed as materialize

        events = decode_events(batch)
        todo = consumable(events, self.jobs)
        routed = outbox.skip_reason(todo, self.mapping)
        tr = materialize(outbox.transition(routed, self.results_fn(routed), self.now_ms, self.retry_base_ms))
        self.jobs = materialize(outbox.apply_round(self.jobs, tr))
        self.transitions = tr if self.transitions is None else materialize(self.transitions.unionByName(tr))


class AuditConsumer:
    """STR-6 handler: every message (key, value, batch) in a table, one folder
    per micro-batch, which a replay overwrites."""

    def __init__(self, out_path: str):
        self.out_path = out_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.out_path}/consumer_batch={int(batch_id)}")
