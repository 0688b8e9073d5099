"""The durable outbox: released messages, crashes, changed targets."""

import pytest
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.store import TableStore, scratch_root
from stockflow.streaming import relay, writeback

MAPPING = ", ".join(f"{c} string" for c in S.MAPPING_COLUMNS)


def refuse(routed):
    return routed.where("skip_reason IS NULL").select("job_id", F.lit(False).alias("ok"), F.lit("busy").alias("error"))


def accept(routed):
    return routed.where("skip_reason IS NULL").select("job_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


class Shop:
    """Two SKUs owed on one platform each, a topic folder and both stores."""

    def __init__(self, spark, owed=(("A", 5), ("B", 7))):
        self.spark = spark
        self.root = scratch_root(spark, "test-writeback")
        self.store, self.consumer = TableStore(spark, f"{self.root}/outbox"), TableStore(spark, f"{self.root}/consumer")
        self.mapping = spark.createDataFrame([(sku, None, None, "1", "2", None, "3", "4") for sku in "AB"], MAPPING)
        self.owe(owed, 1, 0)

    def owe(self, owed, number, now):
        targets = self.spark.createDataFrame([(sku, "shopify", units) for sku, units in owed], "internal_sku string, platform string, target_quantity long")
        return writeback.enqueue(self.store, self.consumer, targets, number, now)

    def relay(self, number, now, accepts=None):
        return writeback.relay_round(self.store, self.consumer, number, now, writeback.to_folder(f"{self.root}/topic", accepts))

    def consume(self, results, now):
        writeback.start(self.spark, f"{self.root}/topic", f"{self.root}/checkpoint", self.store, self.consumer, self.mapping, results, now).awaitTermination()

    def jobs(self, now=0):
        rows = writeback.current_jobs(self.store, self.consumer, now).collect()
        return {r.internal_sku: (r.status, r.target_quantity, r.attempts, r.next_attempt_at) for r in rows}

    def log(self):
        return sorted((r.internal_sku, r.attempt_no, r.outcome) for r in self.consumer.read("attempts").collect())


def test_refused_messages_are_due_at_once_and_leases_run_out(spark):
    shop = Shop(spark)
    assert shop.relay(2, 100, F.col("key") != "A")
    assert shop.jobs() == {"A": ("pending", 5, 0, 100), "B": ("pending", 7, 0, 30_100)}
    assert not shop.relay(2, 100)  # published
    assert shop.relay(4, 200)      # takes up A alone
    assert shop.relay(6, 30_100)   # B's lease has run out
    told = sorted((r.internal_sku, r.accepted, r.sent_at, r.due_at) for r in shop.store.read("relayed").collect())
    assert told == [("A", False, 100, 100), ("A", True, 200, 30_200), ("B", True, 100, 30_100), ("B", True, 30_100, 60_100)]


def test_relay_that_dies_after_its_claim_strands_nothing(spark):
    shop = Shop(spark)

    def die(messages):
        raise RuntimeError("the topic is away")

    with pytest.raises(RuntimeError):
        writeback.relay_round(shop.store, shop.consumer, 2, 100, die)
    assert shop.jobs()["A"] == ("pending", 5, 0, 30_100)
    assert not shop.relay(2, 100) and shop.relay(4, 30_100)
    assert shop.store.read("relayed").count() == 2


def test_crash_between_write_and_commit_takes_effect_once(spark, monkeypatch):
    shop = Shop(spark)
    shop.relay(2, 0)
    commit = TableStore._write_manifest

    def crash(self, m):
        if "consumer" in self.root:
            raise OSError("killed")
        commit(self, m)

    monkeypatch.setattr(TableStore, "_write_manifest", crash)
    with pytest.raises(Exception, match="killed"):
        shop.consume(refuse, 10)
    monkeypatch.setattr(TableStore, "_write_manifest", commit)
    assert shop.jobs()["A"] == ("pending", 5, 0, 30_000)
    shop.consume(refuse, 10)
    shop.consume(refuse, 10)
    assert shop.log() == [("A", 1, "retry_scheduled"), ("B", 1, "retry_scheduled")]
    assert shop.jobs()["A"] == ("pending", 5, 1, 5010)
    batch = spark.createDataFrame([("A", "{}", "f", 0)], "key string, value string, topic_file string, topic_pos long")
    assert not writeback.process(shop.store, shop.consumer, batch, 0, shop.mapping, refuse, 10)


def test_messages_by_what_became_of_them(spark):
    shop = Shop(spark)
    shop.relay(2, 0, F.col("key") == "A")
    shop.relay(4, 1, F.col("key") == "B")
    shop.owe([("B", 6)], 6, 2)
    row = {r.internal_sku: r for r in shop.store.read("jobs").collect()}
    again = relay.encode_events(spark.createDataFrame([row["A"]], S.PUSH_JOB))
    odd = spark.createDataFrame([("Z", '{"job_id": 12, "internal_sku": "Z"}'), ("Y", "no json"), (None, None)], "key string, value string")
    again.unionByName(odd).write.mode("append").parquet(f"{shop.root}/topic")
    shop.consume(accept, 10)
    told = sorted((r.key or "", r.fate, r.stale) for r in shop.consumer.read("messages").collect())
    assert told == [("", "undecodable", False), ("A", "attempted", False), ("A", "repeated", False), ("B", "attempted", True), ("Y", "undecodable", False),
                    ("Z", "unknown_job", False)]
    # The job's own target was delivered, not that of the message.
    assert {r.internal_sku: r.target_quantity for r in shop.consumer.read("attempts").collect()} == {"A": 5, "B": 6}
    again.write.mode("append").parquet(f"{shop.root}/topic")
    shop.consume(accept, 20)
    assert shop.consumer.read("messages").where("fate = 'not_pending'").count() == 1 and len(shop.log()) == 2


def test_target_that_changes_during_delivery_is_owed_again(spark):
    shop = Shop(spark)
    shop.relay(2, 0)
    before = shop.store.read("jobs").collect()
    shop.consume(accept, 10)
    # The outbox changes B's target without having seen the consumer's result.
    changed = spark.createDataFrame([r.asDict() | ({"target_quantity": 3} if r.internal_sku == "B" else {}) for r in before], S.PUSH_JOB)
    writeback._publish(shop.store, 4, changed, -1)
    assert shop.jobs(50) == {"A": ("succeeded", 5, 1, 30_000), "B": ("pending", 3, 0, 50)}
    shop.relay(6, 50)
    shop.consume(accept, 60)
    assert shop.jobs(70) == {"A": ("succeeded", 5, 1, 30_000), "B": ("succeeded", 3, 1, 30_050)}
    # A target owed after the end of a job is a new job.
    shop.owe([("A", 1)], 8, 90)
    assert sorted(r.status for r in shop.store.read("jobs").where("internal_sku = 'A'").collect()) == ["pending", "succeeded"]


def test_dead_letters_are_requeued_once_and_open_an_epoch(spark):
    shop = Shop(spark, owed=())
    targets = spark.createDataFrame([("A", "shopify", 5), ("B", "shopify", 7)], "internal_sku string, platform string, target_quantity long")
    assert writeback.enqueue(shop.store, shop.consumer, targets, 2, 0, max_attempts=1)
    shop.relay(3, 0)
    shop.consume(refuse, 0)
    assert {k: v[0] for k, v in shop.jobs().items()} == {"A": "dead_letter", "B": "dead_letter"}
    dead = writeback.current_jobs(shop.store, shop.consumer, 0)
    unknown = spark.createDataFrame([(-1,)], "job_id long")
    ids = dead.where("internal_sku = 'A'").select("job_id")
    assert writeback.requeue(shop.store, shop.consumer, ids.unionByName(ids).unionByName(unknown), 6, 1000)
    now = shop.jobs()
    assert now["A"] == ("pending", 5, 0, 1000) and now["B"][:3] == ("dead_letter", 7, 1)
    assert not writeback.requeue(shop.store, shop.consumer, ids, 6, 1000)         # published
    assert writeback.requeue(shop.store, shop.consumer, ids, 7, 1500)             # no dead letter any more: no marker
    shop.relay(8, 1000)
    shop.consume(accept, 1000)
    assert shop.store.read("requeued").count() == 1
    got = sorted((r.internal_sku, r.epoch, r.attempt_no, r.outcome) for r in writeback.attempt_epochs(shop.store, shop.consumer).collect())
    assert got == [("A", 0, 1, "dead_letter"), ("A", 1, 1, "succeeded"), ("B", 0, 1, "dead_letter")]


def test_no_table_is_gathered_in_the_driver(spark, monkeypatch):
    """Messages, jobs, states and mappings meet by key, however small Spark holds their files to be."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    keep, publish = writeback.materialize, TableStore.publish
    monkeypatch.setattr(writeback, "materialize", lambda df: keep(noted(df)))
    monkeypatch.setattr(TableStore, "publish", lambda self, n, state=None, append=None, **more: publish(
        self, n, {k: noted(v) for k, v in (state or {}).items()}, {k: noted(v) for k, v in (append or {}).items()}, **more))
    shop = Shop(spark, owed=())
    targets = spark.createDataFrame([("A", "shopify", 5), ("B", "shopify", 7)], "internal_sku string, platform string, target_quantity long")
    writeback.enqueue(shop.store, shop.consumer, targets, 2, 0, max_attempts=2)
    for number, now, results in ((3, 0, refuse), (5, 5000, refuse), (8, 6000, accept)):
        if number == 8:
            writeback.requeue(shop.store, shop.consumer, writeback.current_jobs(shop.store, shop.consumer, now), 7, now)
        shop.relay(number, now)
        shop.consume(results, now)
    log = noted(writeback.attempt_epochs(shop.store, shop.consumer))
    assert sorted((r.internal_sku, r.epoch, r.attempt_no, r.outcome) for r in log.collect()) == [
        (sku, *made) for sku in "AB" for made in ((0, 1, "retry_scheduled"), (0, 2, "dead_letter"), (1, 1, "succeeded"))]
    assert not any("Broadcast" in p for p in plans) and sum("SortMergeJoin" in p for p in plans) > 20
