"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _both_ways(one_way: DataFrame) -> DataFrame:
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _one_way(a: str, b: str, links: DataFrame) -> DataFrame:
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link; ``rows``: a bound of the links.

    First every node stands for its smallest neighbour, and links between the same two of these become one: a
    large group of copies around a few texts shrinks to the links of these few. Then labels take the minimum
    over neighbours and jump to their label's label, so that the number of rounds grows with the logarithm of
    the longest path. Each round is written to the shared folder. Sums over links are partial before they
    shuffle, and joins are inner ones that adaptive execution may split.
    """
    spark = links.sparkSession
    given = stored(_one_way(a, b, links), "links", rows)
    n = given.count()
    parents = stored(_both_ways(given).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "parents", 2 * n)
    of = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")).hint("shuffle_merge")
    few = stored(_one_way("pa", "pb", given.join(of("a"), "a").join(of("b"), "b")), "contracted", n)
    drop_stored(spark, given)
    labels = _labels(few)
    far = labels.select(F.col("node").alias("parent"), "component").hint("shuffle_merge")
    return parents.join(far, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))


def _labels(one_way: DataFrame) -> DataFrame:
    spark = one_way.sparkSession
    both = stored(_both_ways(one_way), "links")
    rows = both.count()
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", rows)
    while rows:
        near = both.join(labels.hint("shuffle_merge"), both["b"] == labels["node"]).select(F.col("a").alias("node"), "component")
        low = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        low = stored(low, "low", rows)
        far = low.select(F.col("node").alias("component"), F.col("component").alias("farther"))
        jumped = low.join(far.hint("shuffle_merge"), "component").select("node", F.col("farther").alias("component"))
        before = labels.select("node", F.col("component").alias("before"))
        new = stored(jumped, "labels", rows)
        changed = new.join(before, "node").filter("component < before").limit(1).count()
        drop_stored(spark, low)
        drop_stored(spark, labels)
        labels = new
        if not changed:
            drop_stored(spark, both)
            break
    return labels
