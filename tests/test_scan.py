"""The two-scan ledger against a sequential fold, with hot keys spread over many chunks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stockflow.operators import ledger


def _fold(events):
    """Brute-force sequential fold, as the reference applies changes."""
    units, exists, out = {}, set(), []
    for e in events:
        sku = e["sku"]
        if e["kind"] == 0:
            old = units.get(sku) if sku in exists else None
            new = e["units"]
            if new is not None and new != old:
                out.append((sku, e["t"], e["pos"], "import_snapshot", new - (old or 0), old, new))
            units[sku] = new
            exists.add(sku)
        else:
            if sku not in exists or units.get(sku) is None:
                continue
            before = units[sku]
            after = max(0, before - e["q"])
            units[sku] = after
            out.append((sku, e["t"], e["pos"], "sale", after - before, before, after))
    return sorted(out, key=repr), units


def _events(seed, n=400, skus=4):
    rnd = random.Random(seed)
    ev = []
    for i in range(n):
        sku = f"S{rnd.randrange(skus)}"
        t = rnd.randrange(0, 90)
        if rnd.random() < 0.08 or i < skus:
            units = None if rnd.random() < 0.15 else rnd.randrange(0, 60)
            ev.append({"sku": sku, "t": t, "kind": 0, "pos": i, "units": units, "q": None})
        else:
            ev.append({"sku": sku, "t": t, "kind": 1, "pos": i, "units": None, "q": rnd.randrange(1, 12)})
    for s in range(skus):
        ev.append({"sku": f"S{s}", "t": -1, "kind": 0, "pos": -1 - s, "units": 30, "q": None})
    ev.sort(key=lambda e: (e["t"], e["kind"], e["pos"]))
    return ev


def _changes(spark, ev):
    base = dt.datetime(2020, 1, 1)
    rows = [(e["sku"], base + dt.timedelta(days=e["t"]), e["kind"], e["pos"], e["units"], e["q"]) for e in ev]
    df = spark.createDataFrame(rows, "sku string, ts timestamp_ntz, kind int, pos long, units long, q long")
    seq = F.struct(F.col("ts"), F.col("kind"), F.col("pos").alias("doc_pos"),
                   F.lit(None).cast("long").alias("line_pos"), F.lit(None).cast("long").alias("tie1"),
                   F.lit(None).cast("double").alias("tie2")).alias("seq")
    imports = df.filter("kind = 0").select(
        F.col("sku").alias("internal_sku"), seq, F.col("units").alias("available_units"),
        F.lit("tier1").alias("tier"), F.lit(1).alias("sync_enabled"))
    sales = df.filter("kind = 1").select(
        F.col("sku").alias("internal_sku"), seq, F.col("q").alias("quantity"),
        F.lit("shopify").alias("platform"), F.lit("o").alias("external_order_id"), F.lit("n").alias("note"))
    return ledger.import_rows(imports).unionByName(ledger.sale_rows(sales))


def _folded(app):
    led = ledger.ledger_rows(app).select(
        "internal_sku", "seq.ts", "seq.doc_pos", "reason", "change_units", "before_units", "after_units")
    base = dt.datetime(2020, 1, 1)
    return sorted(((r[0], r[1] and (r[1] - base).days, *r[2:]) for r in led.collect()), key=repr)


def test_fold_equals_scan(spark):
    for seed, chunks in ((1, None), (2, 1), (3, 7), (7, 40)):
        ev = _events(seed, skus=2 if seed == 7 else 4)
        want, final = _fold(ev)
        app = ledger.apply_changes(_changes(spark, ev), chunks=chunks)
        assert _folded(app) == want, (seed, chunks)
        assert {r[0]: r[1] for r in ledger.final_units(app).collect()} == final, (seed, chunks)


def test_hot_key_of_one_instant_is_split(spark):
    """One SKU, one time stamp (or none at all): chunks are cut by the whole order."""
    from stockflow.operators import scan

    ev = [{"sku": "S0", "t": 0, "kind": 0, "pos": -1, "units": 900, "q": None}]
    ev += [{"sku": "S0", "t": 0, "kind": 1, "pos": i, "units": None, "q": 1 + i % 4} for i in range(1000)]
    for changes in (_changes(spark, ev), _changes(spark, ev).withColumn(
            "seq", F.col("seq").withField("ts", F.lit(None).cast("timestamp_ntz")))):
        rows = scan.with_chunks(changes, ["internal_sku"], "seq", 16).select("seq", scan.CHUNK).collect()
        rows.sort(key=lambda r: (r.seq.kind, r.seq.doc_pos))
        ids = [r[scan.CHUNK] for r in rows]
        assert ids == sorted(ids) and len(set(ids)) >= 12
        assert max(ids.count(c) for c in set(ids)) < 250
        got = _folded(ledger.apply_changes(changes, chunks=16))
        want, _ = _fold(ev)
        assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in want] or sorted(
            (r[0], *r[2:]) for r in got if r[5] is not None) == sorted((r[0], *r[2:]) for r in want if r[5] is not None)
