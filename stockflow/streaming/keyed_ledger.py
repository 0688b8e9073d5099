"""STR-2 / STR-3 with keyed state: a micro-batch touches only its own keys.

Two stateful operators in one streaming query, both on Spark's state store
(RocksDB: state lives on the executors' disks, versions in the checkpoint):

* :func:`first_arrivals` remembers, by (platform, event id), which events took
  effect. A replay is a duplicate forever, and only the events of a
  micro-batch are looked up; nothing scans an event table.
* ``StockFold`` remembers, by SKU, the import in force (units, tier,
  flag) and the units sold since. It turns a key's rows, in ``seq`` order,
  into the two columns that :func:`stockflow.operators.ledger.effects` works
  on - what the batch plan gets from its ordered scans - so status, notes and
  ledger values have one definition.

The only Python is the earliest delivery inside a micro-batch, the running sum
and the carried import, over whole columns of a slot's rows: keys are dealt to
slots by hash, and one call serves all keys of a slot. A slot's rows of one
micro-batch meet in one task, in memory: ``files_per_trigger`` bounds a
micro-batch. Across micro-batches changes apply
in the order in which they arrive; a row that arrives late applies then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stockflow import schemas as S
from stockflow.operators import ledger, resolve
from stockflow.operators.dedupe import EVENT_KEY
from stockflow.plans.ingest import valid_line
from stockflow.store import TableStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of events and of SKUs; part of the state's layout, so the same for all runs of a checkpoint.
SLOTS = 512
SKU_SLOTS = 2048
ARRIVAL = ["batch", "doc_pos", "page_pos"]
SEQ = [f.name for f in S.SEQ.fields]
_LINE = "struct<seq:struct<ts:timestamp_ntz,kind:int,doc_pos:bigint,line_pos:bigint,tie1:bigint,tie2:double>,platform_sku:string,variant_id:string,quantity:bigint,quantity_valid:boolean>"
DELIVERY = "platform string, external_event_id string, external_order_id string, note string, batch long, doc_pos long, page_pos long, lines string"
CHANGE = ("internal_sku string, ts timestamp_ntz, kind int, doc_pos long, line_pos long, tie1 long, tie2 double, row_kind string, quantity long, "
          "available_units long, tier string, sync_enabled int, platform string, external_order_id string, note string")
FOLDED = CHANGE + ", cum long, prev_known boolean, prev_units long, prev_tier string, prev_sync int, prev_cum long"


def _whole(frame: pd.DataFrame, schema: str) -> pd.DataFrame:
    """Whole numbers may be missing: nullable types, so that Arrow gets them as they are."""
    kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean"}
    return frame.astype({n: kinds[k] for n, k in (c.split() for c in schema.split(", ")) if k in kinds})


def first_arrivals(orders: DataFrame) -> DataFrame:
    """The delivery of each event that takes effect: the earliest of its
    micro-batch, unless the event was seen before. The earliest is found by slot,
    whose rows stay Arrow columns; what was seen is looked up and noted in the
    state store by Spark's own operator, event by event."""
    columns = [c.split()[0] for c in DELIVERY.split(", ")]

    def earliest(slot: pa.Table) -> pa.Table:
        rows = slot.select(columns)
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ARRIVAL], null_placement="at_start")
        again = rows.select(EVENT_KEY).take(order).to_pandas().duplicated()
        return rows.take(order.filter(pa.array(~again.to_numpy())))

    slot = F.pmod(F.xxhash64(*EVENT_KEY), F.lit(SLOTS))
    return orders.withColumn("slot", slot).groupBy("slot").applyInArrow(earliest, DELIVERY).dropDuplicates(EVENT_KEY)


class StockFold(StatefulProcessor):
    """Change rows with the units sold so far and the import in force before
    them, per SKU. SKUs are grouped by slot, so that a call works on the columns
    of many at once; the state is a map, of which only the SKUs with rows are
    read and written."""

    def init(self, handle) -> None:
        self.stock = handle.getMapState("stock", "internal_sku string", "units long, tier string, sync_enabled int, sold long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows), ignore_index=True)
        f["_sku"], skus = pd.factorize(f["internal_sku"], use_na_sentinel=False)
        f = f.sort_values(["_sku", *SEQ], na_position="first", kind="stable", ignore_index=True)
        skus = [None if pd.isna(v) else v for v in skus]
        held = [self.stock.getValue((v,)) for v in skus] if self.stock.exists() else [None] * len(skus)
        of, n = f.pop("_sku").to_numpy(), len(f)
        first = np.searchsorted(of, np.arange(len(skus)))
        sale = (f["row_kind"] == "sale").to_numpy(bool)
        sold = np.array([h[3] if h else 0 for h in held], np.int64)
        run = f["quantity"].astype("Int64").where(sale, 0).fillna(0).to_numpy(np.int64).cumsum()
        cum = run - np.concatenate([[0], run])[first][of] + sold[of]
        # The last row of the SKU before that is no sale; above the first of them, what the state holds.
        here = np.maximum.accumulate(np.where(sale, -1, np.arange(n)))
        at = np.concatenate([[-1], here[:-1]])
        old = at < first[of]
        take = np.where(old, 0, at)
        known = np.array([h is not None for h in held], bool)
        f["cum"] = cum
        f["prev_known"] = ~old | known[of]
        for i, (name, column, kind) in enumerate((("prev_units", "available_units", "Int64"), ("prev_tier", "tier", "object"), ("prev_sync", "sync_enabled", "Int32"))):
            before = f[column].astype(kind).iloc[take].reset_index(drop=True)
            kept = pd.Series([h[i] if h else None for h in held], dtype=kind).iloc[of].reset_index(drop=True)
            f[name] = before.where(~old, kept)
        f["prev_cum"] = np.where(old, 0, cum[take])
        whole = lambda v: None if pd.isna(v) else int(v)
        end = np.append(first[1:], n) - 1
        last = here[end]
        now = {c: f[c].iloc[np.maximum(last, 0)].tolist() for c in ("available_units", "tier", "sync_enabled")}
        for i, sku in enumerate(skus):
            if last[i] >= first[i]:
                units, tier, sync = (now[c][i] for c in now)
                self.stock.updateValue((sku,), (whole(units), None if pd.isna(tier) else tier, whole(sync), int(cum[end[i]] - cum[last[i]])))
            elif known[i]:
                self.stock.updateValue((sku,), (*held[i][:3], int(cum[end[i]])))
        yield _whole(f, FOLDED).where(pd.notna, None)[[c.split()[0] for c in FOLDED.split(", ")]]

    def close(self) -> None:
        pass


def deliveries(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a delivered document with its lines as JSON text: what lands as the order feed."""
    page = F.col("arrival.page_pos") if "page_pos" in documents.schema["arrival"].dataType.names else F.lit(None)
    packed = lines.groupBy("platform", "external_event_id", "arrival").agg(
        F.to_json(F.collect_list(F.struct("seq", "platform_sku", "variant_id", "quantity", "quantity_valid"))).alias("lines"))
    return documents.where(F.col("external_event_id").isNotNull()).join(packed, ["platform", "external_event_id", "arrival"], "left").select(
        "platform", "external_event_id", "external_order_id", "note", F.col("arrival.batch").alias("batch"), F.col("arrival.doc_pos").alias("doc_pos"),
        page.cast("long").alias("page_pos"), "lines")


def import_feed(imports: DataFrame) -> DataFrame:
    """Import rows as flat change rows."""
    return _flat(ledger.import_rows(imports))


def _flat(changes: DataFrame) -> DataFrame:
    return changes.select("internal_sku", "seq.*", "row_kind", "quantity", "available_units", "tier", "sync_enabled", "platform", "external_order_id", "note")


def applied(orders: DataFrame, imports: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """The change stream with its effects, from two streams: landed
    deliveries and import rows; SKUs are resolved with ``mapping``."""
    won = first_arrivals(orders)
    lines = won.select("platform", "external_order_id", "note", F.explode(F.from_json("lines", f"array<{_LINE}>")).alias("l")).select("platform", "external_order_id", "note", "l.*")
    sales = resolve.resolve_lines(lines, items, mapping).where(valid_line())
    changes = imports.unionByName(_flat(ledger.sale_rows(sales)))
    sku_slot = F.pmod(F.xxhash64("internal_sku"), F.lit(SKU_SLOTS))
    folded = changes.withColumn("slot", sku_slot).groupBy("slot").transformWithStateInPandas(StockFold(), outputStructType=FOLDED, outputMode="Append", timeMode="None")
    prev = F.when(F.col("prev_known"), F.struct(F.col("prev_units").alias("units"), F.col("prev_tier").alias("tier"), F.col("prev_sync").alias("sync_enabled"),
                                                F.col("prev_cum").alias("cum")))
    scanned = folded.select("internal_sku", F.struct(*SEQ).alias("seq"), *ledger.CHANGE_COLUMNS[2:], F.col("cum").alias("_cum"), prev.alias("_prev"))
    return ledger.effects(scanned, ledger.CHANGE_COLUMNS)


def start(spark: SparkSession, order_path: str, import_path: str, items: DataFrame, mapping: DataFrame, store_root: str, checkpoint: str, *,
          files_per_trigger: int | None = None, state_partitions: int | None = None, available_now: bool = True):
    """Start the stream; ledger rows are published per micro-batch.

    ``state_partitions`` is fixed by the first run of a checkpoint; by default
    the session's shuffle partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.conf.get("spark.sql.shuffle.partitions")))

    def feed(path: str, schema: str) -> DataFrame:
        reader = own.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(path)

    here = lambda df, name: own.read.schema(df.schema).parquet(_kept(df, f"{checkpoint}-{name}"))
    out = applied(feed(order_path, DELIVERY), feed(import_path, CHANGE), here(items, "items"), here(mapping, "mapping"))
    store = TableStore(spark, store_root)

    def publish(batch: DataFrame, batch_id: int) -> None:
        TableStore(batch.sparkSession, store_root).publish(batch_id, append={"ledger": ledger.ledger_rows(batch)})

    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(publish)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start(), store


def _kept(df: DataFrame, path: str) -> str:
    """The static side of the stream as files, written once, which every micro-batch reads."""
    df.write.mode("ignore").parquet(path)
    return path
