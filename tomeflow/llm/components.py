"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

LINKS_PER_TASK = 50_000
LEAST_TASKS = 4


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node.

    Each round is two aggregations and two equi-joins over at most as many rows as there are links, written to the shared
    folder by as many tasks as the links need. Stars shrink paths by half or more, so rounds grow with the logarithm of the
    longest path.
    """
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v"), "edges")
    n, state = edges.count(), None
    while n:
        tasks = max(LEAST_TASKS, n // LINKS_PER_TASK)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        down = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).coalesce(tasks)
        lows = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(lows, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lows.select("u", F.col("low").alias("v")))
        edges = written(small.coalesce(tasks).distinct(), "edges", tasks)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state, n = now, now["n"]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
