"""Connected components and shuffle width; intermediate tables go to the shared folder.

Nothing here gathers rows on the driver.  Intermediate tables are written to
the folder named by ``spark.checkpoint.dir``, which every executor can read,
so a lost executor costs recomputation of tasks and never of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder, written

__all__ = ["connected_components", "shared_folder", "width", "written"]


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in ``links``; comp is the smallest id it reaches.

    Alternates the large-star and small-star steps, each a grouped minimum
    joined back on its key.  Neighbour lists are never collected: a hub with a
    third of all links is a skewed join key, which adaptive execution splits.
    Every step is written to the shared folder.  Empty input gives no rows.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "cc")
    nodes = edges.select(F.explode(F.array("v", "u")).alias("id")).distinct()
    state = None
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
        low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(low, "x").where("y > x AND y != m").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("v", "m", F.explode(F.array("v", "u")).alias("w")).where("w != m")
        edges = written(small.select(F.col("w").alias("v"), F.col("m").alias("u")).distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return nodes.join(edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
