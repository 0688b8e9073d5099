"""Ordered per-key scans that survive a hot key.

Two associative scans cover every sequential fold of the reference:

* running sum (inclusive) of an expression, and
* "last non-null value strictly before this row" of an expression
  (``lag`` is the special case of an always-non-null struct wrapper).

There is one form for every key. Rows are range-partitioned by the whole
``(keys, order)``, so a chunk is a contiguous run of that order: a key with
many rows - also many of one instant, or without any time stamp - spans many
chunks, and many small keys share one. Then:

1. per (key, chunk) partial: sum, and the last non-null value
   (``max_by`` on the order) - a partial/final hash aggregate;
2. carry-in per chunk: running sum / last value over the *chunk summary*
   (a key holds at most one row per chunk there);
3. local window per (key, chunk), combined with the carry-in.

The local window and the carry join share the ``(key, chunk)`` hash
partitioning. Chunk ids come from sampled range bounds, so the tagged rows
are cut once (``materialize``): every reader sees the same chunks, also after
an executor is lost.

:func:`keyed_scan` gives the same columns where no later scan needs the chunks:
only keys of very many rows are cut into chunks, all others are dealt by key
and scanned in one window, so their rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.store import by_key

CHUNK = "_scan_chunk"

#: A key with more rows than this spans chunks in :func:`keyed_scan`.
HOT_ROWS = 200_000


def with_chunks(df: DataFrame, keys: list[str], order: str, chunks: int | None = None, materialize=None) -> DataFrame:
    """``df`` with the id of its contiguous chunk of ``(keys, order)``.

    ``chunks``: number of range partitions; by default the session's shuffle
    partitions (fewer where Spark joins small neighbours).
    """
    if materialize is None:
        from stockflow.store import materialize
    cols = [*[F.col(k) for k in keys], F.col(order)]
    dealt = df.repartitionByRange(chunks, *cols) if chunks else df.repartitionByRange(*cols)
    return materialize(dealt.withColumn(CHUNK, F.spark_partition_id()))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    chunks: int | None = None,
    materialize=None,
    stamp: bool = False,
) -> DataFrame:
    """Add running-sum and last-non-null-before columns per key in ``order``.

    ``stamp``: the ``last_before`` values are structs and get the running sums
    of the row they come from as further fields. One pass over the chunks
    gives both: sums inside a chunk first, those of the chunks before it from
    the summary.

    ``order`` names a column whose values give a total order inside each
    key. The output keeps the chunk column: a later scan over the same keys
    and order reuses the chunks (and their partitioning).
    """
    sums = sums or {}
    last_before = last_before or {}
    if CHUNK not in df.columns:
        df = with_chunks(df, keys, order, chunks, materialize)
    # Materialise the scanned expressions once so both branches agree.
    tmp = {f"_scan_s_{n}": e for n, e in sums.items()}
    tmp.update({f"_scan_l_{n}": e for n, e in last_before.items()})
    base = df.select("*", *[e.alias(n) for n, e in tmp.items()])

    w = Window.partitionBy(*keys, CHUNK).orderBy(order)
    incl = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = w.rowsBetween(Window.unboundedPreceding, -1)
    fields = {n: base.schema[f"_scan_l_{n}"].dataType.names for n in last_before} if stamp else {}

    def stamped(value: Column, n: str, totals: dict[str, Column]) -> Column:
        """The struct ``value`` with these sums."""
        if not stamp:
            return value
        return F.when(value.isNotNull(), F.struct(*[value[f].alias(f) for f in fields[n]], *[c.alias(s) for s, c in totals.items()]))

    summed = base.select("*", *[F.coalesce(F.sum(f"_scan_s_{n}").over(incl), F.lit(0)).alias(f"_local_s_{n}") for n in sums])
    inside = {n: F.col(f"_local_s_{n}") for n in sums}
    marked = summed.select(*[c for c in summed.columns if not c.startswith("_scan_l_")],
                           *[stamped(F.col(f"_scan_l_{n}"), n, inside).alias(f"_scan_l_{n}") for n in last_before])

    aggs = []
    for n in sums:
        aggs.append(F.sum(f"_scan_s_{n}").alias(f"_part_s_{n}"))
    for n in last_before:
        c = F.col(f"_scan_l_{n}")
        aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_part_l_{n}"))
    summary = (marked if stamp else base).groupBy(*keys, CHUNK).agg(*aggs)
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("*", *[F.coalesce(F.sum(f"_part_s_{n}").over(wc), F.lit(0)).alias(f"_carry_s_{n}") for n in sums])

    def whole(value: Column) -> dict[str, Column]:
        """The sums of a struct that counts inside its chunk, over all chunks."""
        return {s: value[s] + F.col(f"_carry_s_{s}") for s in sums} if stamp else {}

    parts = {n: F.col(f"_part_l_{n}") for n in last_before}
    carry = carry.select(*keys, CHUNK, *[f"_carry_s_{n}" for n in sums],
                         *[F.last(stamped(v, n, whole(v)), ignorenulls=True).over(wc).alias(f"_carry_l_{n}") for n, v in parts.items()])

    local = marked.select("*", *[F.last(f"_scan_l_{n}", ignorenulls=True).over(excl).alias(f"_local_l_{n}") for n in last_before])
    joined = local.join(by_key(carry), on=[*keys, CHUNK], how="inner")
    out_cols = [F.col(c) for c in df.columns]
    for n in sums:
        out_cols.append((F.col(f"_local_s_{n}") + F.col(f"_carry_s_{n}")).alias(n))
    for n in last_before:
        here = F.col(f"_local_l_{n}")
        out_cols.append(F.coalesce(stamped(here, n, whole(here)), F.col(f"_carry_l_{n}")).alias(n))
    return joined.select(*out_cols)


def hot_keys(df: DataFrame, keys: list[str], materialize=None) -> DataFrame | None:
    """The keys with more than ``HOT_ROWS`` rows in ``df``, one row each; None if there are none."""
    if materialize is None:
        from stockflow.store import materialize
    hot = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT_ROWS).select(*keys))
    return None if hot.isEmpty() else hot


def keyed_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    materialize=None,
    stamp: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The columns of :func:`ordered_scan`, without the chunks. ``hot``: the
    keys of :func:`hot_keys`, the only ones whose rows are cut into chunks;
    None if there are none. ``df`` is read twice where there are some."""
    sums, last_before = sums or {}, last_before or {}
    rest = df if hot is None else df.join(hot, keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(order)
    incl = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rest.dropna(subset=keys).select("*", *[e.alias(f"_scan_l_{n}") for n, e in last_before.items()],
                                           *[F.coalesce(F.sum(e).over(incl), F.lit(0)).alias(f"_scan_s_{n}") for n, e in sums.items()])

    def marked(n: str) -> Column:
        value = F.col(f"_scan_l_{n}")
        if not stamp:
            return value
        names = rows.schema[f"_scan_l_{n}"].dataType.names
        return F.when(value.isNotNull(), F.struct(*[value[f].alias(f) for f in names], *[F.col(f"_scan_s_{s}").alias(s) for s in sums]))

    rows = rows.select(*[F.col(c) for c in df.columns], *[F.col(f"_scan_s_{n}").alias(n) for n in sums], *[marked(n).alias(f"_scan_l_{n}") for n in last_before])
    out = rows.select(*[F.col(c) for c in [*df.columns, *sums]], *[F.last(f"_scan_l_{n}", ignorenulls=True).over(excl).alias(n) for n in last_before])
    if hot is None:
        return out
    cut = ordered_scan(df.join(hot, keys, "left_semi"), keys, order, sums, last_before, materialize=materialize, stamp=stamp)
    return out.unionByName(cut.select(*out.columns))
