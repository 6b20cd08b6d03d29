"""Connected components of a table of links, by alternating star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with the least neighbour of u; sums of a hub's links are taken before the shuffle."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down)
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v: long): the root is the least node that can be reached.

    Self links and repeated links are allowed, nulls are not. Every round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain. Nothing but two sums reaches the driver.
    """
    links = stored(links.where("u <> v").distinct())
    before = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        links = stored(_small_star(_large_star(links).distinct()).distinct())
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
