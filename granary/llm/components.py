"""Connected components of a large link table, as alternating large-star and small-star rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """links: pairs of longs (any order, repeats and loops allowed). Returns node, root: every node that has a link, with the least node that it can reach.

    A round of large-star links every larger neighbour of a node to the node's least neighbour, small-star every smaller one; both keep the components and the number of rounds grows with the logarithm of
    their size, also for long chains. Each round aggregates minima before it joins them back, so no neighbourhood is gathered in one place; its result is a
    table in the shared folder, which is deleted after the next. Rounds end when the links no longer change."""
    a, b = F.col(left), F.col(right)
    edges = materialise(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").filter("y != m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        before, edges = edges, materialise(small, "small")
        release(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select("v", "v").distinct()).distinct()
