"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one (or itself)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest. Expects u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(links: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """Rows (node, component) for every node that occurs in a link; component is its smallest node.

    Each round is a few shuffles of at most as many rows as there are links; its result is written to the
    shared folder. The number of rounds grows with the logarithm of the longest path. Links with a null end
    and links of a node to itself are left out; repeated links and an empty table are fine.
    """
    links = links.filter(f"{a} is not null and {b} is not null and {a} != {b}")
    links = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    for _ in range(most):
        links = stage(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
