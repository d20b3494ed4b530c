"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def components(links: DataFrame, work: Work) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that links reach.

    Each round, every node takes one of itself and its neighbours as parent, and links are
    drawn anew between parents until none is left; a node's component is where its chain of
    parents ends. In the first round the smallest id is the parent, which settles stars
    around their smallest id. Later rounds take the lowest hash and go on to the parent's
    parent: whatever the order of the ids, a round leaves less than half of a path's nodes
    on average, so rounds grow with the logarithm of the longest path. Both ends of a hot node's links are summed before they are shuffled, and joins on
    it are plain joins that Spark splits where they are skewed. No links give no rows; links
    that repeat, turn round or lead to their own start change nothing; null ends are no links.
    """
    links = work.keep(links.select("a", "b").filter("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        if steps:
            parent = work.keep(_lowest(both), "nearest")
            above = parent.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
            parent = parent.join(above, "parent").select("id", F.col("next").alias("parent"))
        else:
            parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("parent"))
        parent = work.keep(parent, "parents")
        steps.append(parent)
        moved = links.join(parent.select(F.col("id").alias("a"), F.col("parent").alias("pa")), "a")
        moved = moved.join(parent.select(F.col("id").alias("b"), F.col("parent").alias("pb")), "b")
        moved = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct()
        links = work.keep(moved, "links")
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # the last round's parents are final; a parent that a later round doesn't know stays as it is
    found = steps[-1].withColumnRenamed("parent", "component")
    for parent in reversed(steps[:-1]):
        later = found.withColumnRenamed("id", "parent")
        found = work.keep(parent.join(later, "parent", "left").select("id", F.coalesce("component", "parent").alias("component")), "found")
    if len(steps) == 1:
        return found
    # roots are nodes of low hash: the smallest id of each one's nodes names the component
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return work.keep(found.join(least, "component").select("id", F.col("least").alias("component")), "named")


def _lowest(both: DataFrame) -> DataFrame:
    """(id, parent): of each node and its neighbours the one with the lowest hash, which no other number shares."""
    best = both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.xxhash64("b")).alias("b"), F.min(F.xxhash64("b")).alias("h"))
    return best.select("id", F.when(F.col("h") < F.xxhash64("id"), F.col("b")).otherwise(F.col("id")).alias("parent"))
