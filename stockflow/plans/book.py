"""A service-style facade over the operators: the calls a user of the
reference makes (import, ingest both channels, dispatch, requeue,
reconcile, read models), each one a batch of Spark jobs over the current
table versions.

State lives in DataFrames that are materialised after every call (reliable
checkpoints); :mod:`stockflow.streaming.live_ingest` is the durable form over
:class:`TableStore`. Every call is one
batch; the batch number orders changes across calls (``seq.ts`` is the
batch instant, ``doc_pos`` / ``line_pos`` the positions inside it).
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow import schemas as S
from stockflow.functions import normalize as N
from stockflow.operators import items as items_op
from stockflow.operators import ledger, outbox, reconcile, reports
from stockflow.plans.ingest import ingest
from stockflow.sources import landing, orders_json
from stockflow.store import checkpointed as materialize
from stockflow.store import scratch

_EPOCH = _dt.datetime(2000, 1, 1)
EVENT_SCHEMA = ("platform string, external_event_id string, external_order_id string, order_name string, "
                "order_status string, raw_payload string, processed int, processed_batch bigint, batch bigint")


class StockBook:
    def __init__(self, spark: SparkSession, push_enabled: bool = True, retry_base_ms: int = S.PUSH_RETRY_BASE_MS,
                 max_attempts: int = S.PUSH_MAX_ATTEMPTS, default_location: str | None = None,
                 inline_push: bool = False):
        self.spark = spark
        self.push_enabled = push_enabled
        self.retry_base_ms = retry_base_ms
        self.max_attempts = max_attempts
        self.default_location = default_location
        self.inline_push = inline_push
        self.batch = 0
        item_schema = ("internal_sku string, product_name string, tier string, sync_enabled int, "
                       "monitoring_enabled int, available_units bigint, low_stock_threshold bigint, "
                       "units_per_pack bigint, notes string")
        map_schema = ", ".join(f"{c} string" for c in S.MAPPING_COLUMNS)
        self.items = spark.createDataFrame([], item_schema)
        self.mapping = spark.createDataFrame([], map_schema)
        self.events = spark.createDataFrame([], EVENT_SCHEMA)
        self.event_items = None
        self.quarantine = None
        self.ledger = None
        self.jobs = outbox.empty_jobs(spark)
        self.logs = None
        self.runs = None
        self.run_details = None

    # ---------------------------------------------------------------- helpers
    def _next_batch(self) -> tuple[int, F.Column]:
        self.batch += 1
        ts = _EPOCH + _dt.timedelta(seconds=self.batch)
        return self.batch, F.lit(ts).cast("timestamp_ntz")

    def _append(self, cur: DataFrame | None, new: DataFrame) -> DataFrame:
        """Append-only tables: materialise only the new batch and union it
        lazily with earlier batches (history is never rewritten)."""
        new = materialize(new)
        return new if cur is None else cur.unionByName(new, allowMissingColumns=True)

    def _text_rows(self, docs: Iterable[dict | str] | DataFrame, batch: int) -> DataFrame:
        """Documents as ``value`` and ``arrival``. A frame needs ``value``,
        ``file`` and ``pos`` (see :mod:`stockflow.sources.landing`) and stays
        distributed; a list is for a handful of documents."""
        if isinstance(docs, DataFrame):
            return landing.with_arrival(docs, batch).select("value", "arrival")
        rows = [(json.dumps(d) if not isinstance(d, str) else d, i) for i, d in enumerate(docs)]
        df = self.spark.createDataFrame(rows, "value string, doc_pos long")
        return df.select("value", F.struct(F.lit(batch).cast("long").alias("batch"),
                                           F.col("doc_pos")).alias("arrival"))

    # ---------------------------------------------------------------- import
    def import_inventory_rows(self, rows: DataFrame | list[dict]) -> DataFrame:
        """STA-6: upsert items and mappings, ledger rows for unit changes.

        A frame is one of a file scan, or has ``file`` and ``pos``: its rows
        apply in file order, so the last row of a SKU wins."""
        if isinstance(rows, list):
            cols = sorted({k for r in rows for k in r})
            pdf = pd.DataFrame([{c: r.get(c) for c in cols} for r in rows], columns=cols).astype(object)
            pdf["pos"] = range(len(pdf))
            schema = ", ".join(f"{c} string" for c in cols) + ", pos long"
            raw = self.spark.createDataFrame(pdf, schema).withColumn("file", F.lit(""))
        else:
            raw = rows if {"file", "pos"} <= set(rows.columns) else landing.with_places(rows)
        batch, ts = self._next_batch()
        norm = N.import_rows(landing.import_order(raw, ts), self.default_location)
        norm = materialize(norm)
        changes = ledger.import_rows(norm).unionByName(ledger.state_rows(self.items))
        with scratch():
            applied = materialize(ledger.apply_changes(changes))
        new_rows = ledger.ledger_rows(applied)
        self.ledger = self._append(self.ledger, new_rows)
        units = ledger.final_units(applied)
        items = items_op.upsert(self.items, norm, "internal_sku", S.ITEM_COLUMNS)
        self.items = materialize(items_op.with_units(items, units))
        self.mapping = materialize(items_op.upsert(self.mapping, norm, "internal_sku", S.MAPPING_COLUMNS))
        return new_rows

    # ---------------------------------------------------------------- ingest
    def ingest_shopify_orders(self, orders: Iterable[dict | str] | DataFrame, now_ms: int = 0,
                              sink: Callable | None = None) -> DataFrame:
        batch, ts = self._next_batch()
        docs, lines = orders_json.shopify_documents(self._text_rows(orders, batch), ts=ts)
        return self._ingest(docs, lines, batch, now_ms, sink)

    def ingest_etsy_receipts(self, receipts: Iterable[dict | str] | DataFrame, now_ms: int = 0,
                             sink: Callable | None = None) -> DataFrame:
        batch, ts = self._next_batch()
        docs, lines = orders_json.etsy_documents(self._text_rows(receipts, batch), ts=ts)
        return self._ingest(docs, lines, batch, now_ms, sink)

    def _ingest(self, docs: DataFrame, lines: DataFrame, batch: int, now_ms: int,
                sink: Callable | None) -> DataFrame:
        """STA-7; returns the per-line results of this batch (+ duplicate docs);
        documents without an id go to ``quarantine``."""
        store = self.events.select("platform", "external_event_id")
        ing = ingest(docs, lines, self.items, self.mapping, state=self.items, store=store,
                     materialize=materialize, inline_push=self.inline_push)
        sales = ing.applied.filter(F.col("row_kind") == "sale")
        self.ledger = self._append(self.ledger, ledger.ledger_rows(ing.applied))
        self.items = materialize(items_op.with_units(self.items, ledger.final_units(ing.applied)))
        self.jobs = materialize(outbox.enqueue(self.jobs, outbox.owed_targets(sales), batch, now_ms,
                                               self.max_attempts))
        # SNK-1/SNK-7: the event row and its lines are published with the
        # stock change of the same batch, already marked processed.
        won = ing.documents.filter(F.col("status") == "processed").select(
            "platform", "external_event_id", "external_order_id", "order_name", "order_status",
            F.col("raw_payload").cast("string").alias("raw_payload"), F.lit(1).alias("processed"),
            F.lit(batch).cast("long").alias("processed_batch"), F.lit(batch).cast("long").alias("batch"))
        self.events = self._append(self.events, won)
        event_items = ing.lines.select(
            "platform", "external_event_id", "seq", "platform_sku", "internal_sku", "quantity", "unit_price",
            "title", F.lit(batch).cast("long").alias("batch"))
        self.event_items = self._append(self.event_items, event_items)
        self.quarantine = self._append(self.quarantine, ing.quarantine.withColumn("batch", F.lit(batch).cast("long")))
        results = ing.line_results.unionByName(
            ing.documents.filter(F.col("status") == "duplicate").select(
                "platform", "external_order_id", F.lit(None).alias("seq"),
                F.lit(None).cast("string").alias("internal_sku"), F.lit(None).cast("long").alias("quantity"),
                F.lit("duplicate").alias("status"), F.lit(None).cast("string").alias("message"),
                F.lit(None).cast("long").alias("before_units"), F.lit(None).cast("long").alias("after_units"),
                F.lit(None).cast("boolean").alias("oversold")),
            allowMissingColumns=True)
        results = materialize(results)
        if self.inline_push and sink is not None:
            self.process_due_push_jobs(now_ms, sink=sink)
        return results

    # ---------------------------------------------------------------- reset / seed
    def reset(self, rows: DataFrame | list[dict]) -> DataFrame:
        """SNK-10: empty every table (new empty versions), then import ``rows``."""
        fresh = StockBook(self.spark, self.push_enabled, self.retry_base_ms, self.max_attempts,
                          self.default_location, self.inline_push)
        fresh.batch = self.batch
        self.__dict__.update(fresh.__dict__)
        return self.import_inventory_rows(rows)

    def seed_if_empty(self, rows: DataFrame | list[dict]) -> bool:
        """SNK-11: import only when there is no item yet."""
        if self.items.isEmpty():
            self.import_inventory_rows(rows)
            return True
        return False

    # ---------------------------------------------------------------- outbox
    def process_due_push_jobs(self, now_ms: int, limit: int | None = None,
                              sink: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
        """STA-3: one dispatch round over all due jobs (or the ``limit`` oldest); returns the transitions."""
        sink = sink or (lambda pdf: pdf.assign(ok=True, error=None))

        def results(routed: DataFrame) -> DataFrame:
            return outbox.deliver(routed, sink)

        new_jobs, tr = outbox.dispatch_round(self.jobs, self.mapping, results, now_ms, limit,
                                             self.push_enabled, self.default_location, self.retry_base_ms)
        tr = materialize(tr)
        self.jobs = materialize(outbox.apply_round(self.jobs, tr))
        log = tr.select("internal_sku", "platform", "target_quantity", F.col("log_status").alias("status"),
                        "message", F.lit(self.batch).cast("long").alias("batch"))
        self.logs = self._append(self.logs, log)
        return tr

    def requeue_dead_letter(self, job_ids: list[int], now_ms: int) -> DataFrame:
        ids = self.spark.createDataFrame([(int(i),) for i in job_ids], "job_id long")
        self.jobs = materialize(outbox.requeue(self.jobs, ids, now_ms))
        return self.jobs.join(ids, "job_id", "left_semi")

    def dead_letters(self) -> DataFrame:
        return outbox.dead_letters(self.jobs)

    # ---------------------------------------------------------------- reconcile
    @scratch()
    def reconcile(self, persist: bool = True) -> dict[str, DataFrame]:
        led = self.ledger if self.ledger is not None else self.spark.createDataFrame(
            [], ledger.ledger_rows(ledger.apply_changes(ledger.state_rows(self.items))).schema)
        rep = reconcile.reconcile(led, self.items)
        rep = {k: materialize(v) for k, v in rep.items()}
        if persist:
            run_no = 0 if self.runs is None else self.runs.count()
            self.runs = self._append(self.runs, reconcile.run_record(rep, run_no + 1))
            self.run_details = self._append(self.run_details, reconcile.run_details(rep, run_no + 1))
        return rep

    # ---------------------------------------------------------------- read models
    def snapshot(self) -> DataFrame:
        return reports.inventory_snapshot(self.items, self.mapping)

    def low_stock(self) -> DataFrame:
        return reports.low_stock(self.items)

    def recent_ledger(self, limit: int = S.RECENT_DEFAULT_LIMIT) -> DataFrame:
        return reports.recent(self.ledger, ["seq", "internal_sku"], limit)

    def recent_jobs(self, limit: int = S.RECENT_DEFAULT_LIMIT) -> DataFrame:
        return reports.recent(self.jobs, ["created_batch", "job_id"], limit)

    def reconciliation_runs(self, limit: int = S.RECONCILE_RUNS_LIMIT) -> DataFrame:
        return reports.recent(self.runs, ["run_id"], limit)
