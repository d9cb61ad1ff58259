"""Connected components of links between 64-bit nodes, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _mark(links: DataFrame) -> tuple:
    """A digest of a set of links: equal before and after a round once nothing changes."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _centres(links: DataFrame, own: bool) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return least.withColumn("m", F.least("u", "m")) if own else least


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, component) for every node that isn't the smallest of its component.

    Each round joins every node to the smallest node it sees, first with its larger neighbours,
    then with its smaller ones, until the links are stars; the number of rounds grows with the
    logarithm of the longest path. Links stay in tables: partial minima before each shuffle, and
    joins that Spark can split where one node has very many links. Links of a node with itself
    and repeated links change nothing; links with null ends are dropped; no links give no rows.
    most: how many links there are at most, if that is known. A round makes no more links than it
    gets, so its tables need few files.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    links = checkpoint(links, most)
    before = _mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours go to the smallest node seen.
        large = both.join(_centres(both, True), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Smaller neighbours, and the node itself, go to the smallest of them.
        least = _centres(large, False)
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), before[0])
        after = _mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
