"""Connected components of a link table, by alternating stars.

Large star: every larger neighbour of a node is linked to the smallest node
around it.  Small star: so are the smaller neighbours and the node itself.
Both keep the components, and the links turn into one star per component in
about log(nodes) rounds.  Links stay in tables (of files of ``FILE_ROWS`` links:
they are few beside the documents); the driver sees a count, and per round
whether the stars are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, drop_scratch

MAX_ROUNDS = 60
FILE_ROWS = 250_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_n", "_m"))
    return both.filter("v > u").join(low, F.col("u") == F.col("_n")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m"))
    pulled = e.join(low, F.col("u") == F.col("_n")).select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u != v")
    return pulled.unionByName(low.select(F.col("_n").alias("u"), F.col("_m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Every node has one link, and leads to a node that has none."""
    if not e.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("u").alias("_w")), F.col("v") == F.col("_w"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (u, v): each linked node but the smallest of its
    component, with that smallest node."""
    e = cut_lineage(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    files = e.count() // FILE_ROWS + 2
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            return e
        e, old = cut_lineage(_small_star(_large_star(e)).coalesce(files), "links"), e
        drop_scratch(old)
    raise RuntimeError("components did not settle")
