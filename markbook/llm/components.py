"""Connected components by large-star / small-star rounds over a table of links.

Each round relinks every node to the smallest node seen near it, in two joins whose minima are combined before
the shuffle. A round's links are written in the shared folder, which ends lineage; only a count and a checksum
come to the driver. Rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.storage import Counted


def _canonical(links: DataFrame) -> DataFrame:
    """(u, v) with u > v, once each."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _checksum(links: DataFrame) -> object:
    return links.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v) but the roots themselves; root is the smallest node reachable.

    Rounds go on until one changes nothing.
    """
    now = Counted(_canonical(links), "links")
    state = (now.n, _checksum(now.df))
    while now.n:
        now = Counted(_small_star(_large_star(now.df)), "links")
        before, state = state, (now.n, _checksum(now.df))
        if before == state:
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
