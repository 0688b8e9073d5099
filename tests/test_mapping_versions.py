"""Resolution as of a line's place against a walk over all versions."""

import datetime as dt
import random

from pyspark.sql import types as T

from stockflow.operators import mapping_versions as mv


def test_lines_take_the_mapping_of_their_time(spark):
    rnd = random.Random(5)
    keys = [None, "k1", "k2", "k3", "hot", "hot"]
    versions = [(f"S{rnd.randrange(9)}", (i,), rnd.choice(keys), rnd.choice(keys), rnd.choice(keys)) for i in rnd.sample(range(400), 160)]
    lines = [(rnd.choice(["shopify", "etsy"]), (1000 + i if i < 5 else rnd.randrange(400),), i, rnd.choice([None, "", " k1", "k2", "hot ", "none"]), rnd.choice(keys)) for i in range(300)]
    # A line of the place of a version comes after it here: halves keep the order total.
    versions = [(s, (2 * p[0],), *k) for s, p, *k in versions]
    lines = [(p, (2 * s[0] + 1,), i, sku, v) for p, s, i, sku, v in lines]

    want = {}
    for platform, at, i, sku, variant in lines:
        held = {}
        for s, p, *k in sorted(versions, key=lambda v: v[1]):
            if p < at:
                held[s] = k
        sku = (sku or "").strip() or None

        def lowest(place, key):
            return min((s for s, k in held.items() if key is not None and k[place] == key), default=None)

        want[i] = (lowest(0, variant) or lowest(1, sku)) if platform == "shopify" else lowest(2, sku)
    v = spark.createDataFrame(versions, "internal_sku string, seq struct<at:int>, shopify_variant_id string, shopify_sku string, etsy_sku string")
    df = spark.createDataFrame(lines, "platform string, seq struct<at:int>, id int, platform_sku string, variant_id string")
    got = mv.resolve_as_of(df, v).collect()
    assert len(got) == len(lines) and {r.id: r.internal_sku for r in got} == want
    assert len({x for x in want.values()}) > 5
    assert [r.internal_sku for r in mv.resolve_as_of(df.where("id < 3"), v.limit(0)).collect()] == [None] * 3


def test_a_sale_before_its_import_is_unresolved_in_one_batch_as_in_two(spark):
    from pyspark.sql import functions as F

    from stockflow import schemas as S
    from stockflow.store import TableStore, scratch_root
    from stockflow.streaming import ingest_stream as ing

    def place(day, kind):
        return (dt.datetime(2024, 1, day), kind, 0, 0, None, None)

    def feed(imports, sales):
        new = spark.createDataFrame([(sku, units, key, place(day, 0)) for sku, day, units, key in imports],
                                    T.StructType([T.StructField("internal_sku", T.StringType()), T.StructField("available_units", T.LongType()),
                                                  T.StructField("shopify_sku", T.StringType()), T.StructField("seq", S.SEQ)]))
        fixed = {"tier": F.lit("tier1"), "sync_enabled": F.lit(1), "monitoring_enabled": F.lit(1), "low_stock_threshold": F.lit(0).cast("long"),
                 "units_per_pack": F.lit(None).cast("long")}
        new = new.select(*[F.col(c) if c in new.columns else fixed.get(c, F.lit(None).cast("string")).alias(c) for c in ing.IMPORT_COLS])
        docs = spark.createDataFrame([("shopify", f"e{i}", f"o{i}", f"n{i}", "paid", "", day) for i, day, _ in sales],
                                     "platform string, external_event_id string, external_order_id string, order_name string, order_status string, note string, arrival int")
        lines = spark.createDataFrame([(f"e{i}", place(day, 1), key, 1, True) for i, day, key in sales],
                                      T.StructType([T.StructField("external_event_id", T.StringType()), T.StructField("seq", S.SEQ), T.StructField("platform_sku", T.StringType()),
                                                    T.StructField("quantity", T.LongType()), T.StructField("quantity_valid", T.BooleanType())]))
        lines = docs.join(lines, "external_event_id").withColumns({c: F.lit(None).cast("string") for c in ("variant_id", "unit_price", "title")})
        return ing.change_feed(new, docs, lines)

    def outcome(*batches):
        store = TableStore(spark, scratch_root(spark, "asof"))
        for i, b in enumerate(batches):
            assert ing.process_batch(store, b, i)
        return sorted((r.external_order_id, r.status, r.internal_sku) for r in store.read("line_results").collect())

    start, late = [("A", 1, 9, "x")], [("A", 5, 9, "y"), ("B", 5, 4, "x")]
    sales, later = [(1, 2, "x"), (2, 3, "y")], [(3, 6, "x"), (4, 7, "y")]
    one = outcome(feed(start + late, sales + later))
    assert one == [("o1", "enqueued", "A"), ("o2", "unresolved", None), ("o3", "enqueued", "B"), ("o4", "enqueued", "A")]
    assert outcome(feed(start, sales), feed(late, later)) == one


def test_skus_that_share_a_key_from_the_start(spark):
    """Rows of the mapping before a batch have one place: the lowest SKU holds the key, whatever order they come in."""
    seq = "seq struct<ts:int,n:int>"
    for names in (["S3", "S1", "S2", "S4"], ["S4", "S2", "S1", "S3"], ["S1", "S2", "S3", "S4"]):
        mapping = spark.createDataFrame([(n, None, "k", None) for n in names], "internal_sku string, shopify_variant_id string, shopify_sku string, etsy_sku string").coalesce(1)
        imports = spark.createDataFrame([("S1", (5, 1), None, "other", None), ("S4", (5, 2), None, "k", None)], f"internal_sku string, {seq}, shopify_variant_id string, shopify_sku string, etsy_sku string")
        lines = spark.createDataFrame([("shopify", (t, 9), t, "k", None) for t in (1, 4, 7)], f"platform string, {seq}, id int, platform_sku string, variant_id string")
        got = {r.id: r.internal_sku for r in mv.resolve_as_of(lines, mv.version_rows(mapping, imports)).collect()}
        assert got == {1: "S1", 4: "S1", 7: "S2"}
        told = mv.holders(mv.key_changes(mv.version_rows(mapping, imports))).where("key = 'k'").collect()
        assert sorted((r.seq.ts or 0, r.holder) for r in told) == [(0, "S1"), (5, "S2")]
