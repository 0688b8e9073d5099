"""Tables cut at stage boundaries: what they hold, and what they leave on disk."""

import datetime as dt
import os
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockflow import store as S
from stockflow.plans import catalogue
from stockflow.sources import landing
from stockflow.sources import testdata as TD
from stockflow.streaming import ingest_stream


def folders(spark):
    root = S.checkpoint_dir(spark)
    return {f for f in os.listdir(root) if f.startswith("cut-")} if os.path.isdir(root) else set()


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in found if f.getName().startswith("shuffle_"))


def test_a_cut_gives_back_what_it_was_given(spark):
    rows = [(1, "a ", None, True, dt.datetime(1990, 1, 1, 3), Decimal("1.50"), 0.1, [1, None], {"k": None}, (dt.datetime(1, 1, 1), None), bytearray(b"\x00x"), dt.date(1, 1, 1)),
            (None, "", "x", None, None, None, float("nan"), None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, s string, `odd name;(a)` string, b boolean, t timestamp, d decimal(9,2), f double, a array<long>, "
                                     "m map<string,string>, st struct<ts:timestamp_ntz,n:double>, raw binary, day date")
    cut = S.materialize(df)
    assert cut.dtypes == df.dtypes and sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
    assert S.materialize(df.where("false")).count() == 0
    odd = spark.range(2).select(F.lit(None).alias("nothing"), F.col("id").alias("x"), F.col("id").alias("X"), F.expr("INTERVAL 1 MONTH").alias("span"))
    assert S.materialize(odd).dtypes == odd.dtypes and S.materialize(odd).count() == 2


def test_a_cut_is_small_and_leaves_no_shuffle(spark):
    df = spark.range(200_000).select(F.concat(F.lit("Shopify order #"), F.col("id") % 50_000).alias("note"), (F.col("id") % 7).alias("q"), F.lit(None).cast("long").alias("none"))
    before = shuffle_bytes(spark)
    cut = S.materialize(df.repartition(4, "note"))
    assert shuffle_bytes(spark) <= before
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(cut._cut_path) for f in names)
    assert size < 1_500_000 and cut.count() == 200_000  # a checkpoint takes twice that


def test_a_scope_deletes_what_was_cut_in_it(spark):
    before = folders(spark)
    outer = S.materialize(spark.range(3))
    with S.scratch() as made:
        gone, kept = S.materialize(spark.range(4)), S.materialize(spark.range(5))
        with S.scratch():
            S.materialize(spark.range(6))
        assert len(folders(spark) - before) == 3 and gone.count() == 4
        S.keep(made, kept)
    assert len(folders(spark) - before) == 2 and (outer.count(), kept.count()) == (3, 5)
    with pytest.raises(ValueError), S.scratch():
        S.materialize(spark.range(7))
        raise ValueError
    assert len(folders(spark) - before) == 2
    S.release(outer, kept, spark.range(1))
    assert folders(spark) == before


def tables(spark, at, n=40):
    """Small driver tables: parts, orders of two years and their lines."""
    spark.range(n).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CAST(id % 9 + 1 AS INT) AS p_size").write.parquet(f"{at}/part.parquet")
    spark.range(3 * n).selectExpr("id AS o_orderkey", "IF(id % 2 = 0, 'F', 'O') AS o_orderstatus", "timestamp_ntz'1996-03-01 00:00:00' + make_dt_interval(7 * CAST(id AS INT)) AS o_orderdate",
                                  "'1-URGENT' AS o_orderpriority").write.parquet(f"{at}/orders.parquet")
    spark.range(9 * n).selectExpr(f"id % {3 * n} AS l_orderkey", f"id * 7 % {n} AS l_partkey", "id % 5 AS l_suppkey", f"CAST(id DIV {3 * n} + 1 AS INT) AS l_linenumber",
                                  "CAST(id % 6 + 1 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_a_batch_leaves_only_what_it_published(spark, tmp_path):
    """Neither the ingest of the catalogue nor a micro-batch keeps the tables that lie between its steps."""
    d = tables(spark, tmp_path)
    before = folders(spark)
    ing = catalogue._ingested(spark, d)
    assert {os.path.basename(t._cut_path) for t in (ing.documents, ing.lines, ing.applied)} == folders(spark) - before
    before = folders(spark)
    store = S.TableStore(spark, f"{tmp_path}/{uuid.uuid4().hex}")
    docs = TD.documents(spark, d).select(*ingest_stream.DOC_COLS)
    feed = ingest_stream.change_feed(TD.imports(spark, d), docs, TD.lines(spark, d))
    assert ingest_stream.process_batch(store, feed, 0) and store.read("ledger").count() > 40
    assert folders(spark) == before


def test_landed_bodies_are_checked_once(spark):
    """What was cut after the check is not parsed for it again, and gives the same documents."""
    bodies = [('{"id": 1, "line_items": [{"sku": "A", "quantity": 2}]}', True), ('{"name": "no id"}', True), ("oops", True), ('{"id": 2}', False), (None, False)]
    raw = spark.createDataFrame([("shopify_webhook", v, None, ok, "f", i) for i, (v, ok) in enumerate(bodies)] + [("etsy_pages", '{"results": [{"receipt_id": 7}]}', None, True, "p", 0)],
                                "source string, value string, body binary, accepted boolean, file string, pos long")
    sources = ["etsy_pages", "shopify_webhook"]
    once, again = (landing.canonical(landing.with_arrival(r, 1), sources) for r in (S.materialize(landing.checked(raw, sources)), raw))
    for name, n in (("documents", 2), ("lines", 1), ("rejected", 2), ("malformed", 2)):
        a, b = getattr(once, name), getattr(again, name)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == n
    parsed = [x.documents._jdf.queryExecution().optimizedPlan().toString().count("_corrupt") for x in (once, again)]
    assert parsed[0] == 0 < parsed[1]
