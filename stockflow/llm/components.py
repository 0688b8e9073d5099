"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One step over edges ``u > v``. Large: every node links its larger
    neighbours to its smallest; small: its smaller neighbours and itself."""
    e = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    j = e.join(least, "u")
    if both:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest
    node reachable. Works by shuffles only; rounds grow with the logarithm of
    the longest chain. Nodes are of any orderable type, links without nulls."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges, before = cut(edges, "components"), None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True), False), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
