"""Connected components of an edge table by alternating large-star and small-star rounds.

Only edges move; every round is a few equi-joins and aggregations, so no component is ever
gathered in one task or on the driver.  Each round is checkpointed in the shared folder.  The centre of a very
large star is one join key; adaptive execution splits such a key over tasks (skew join), as its other side is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(common.dealt(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(common.dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    ``edges`` has columns u and v of one orderable type; direction, repeats and self-loops do not matter.
    """
    common.shared_dir(edges.sparkSession)
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        # The edge set is a set of stars exactly when a full round leaves it unchanged.
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        now = _small_star(_large_star(now)).checkpoint()
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
