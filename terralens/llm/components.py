"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.scratch import save


def _jump(parent: DataFrame) -> DataFrame:
    """Follows parents until each row names a root. parent: (id, up), roots are absent; the depth halves each time."""
    while True:
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
        parent = save(parent.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "jump")
        if parent.where("moved").isEmpty():
            return parent.select("id", "up")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b); component is the smallest id that can be reached.

    Each round hooks every vertex to its smallest neighbour if that is smaller, follows the hooks to
    their roots, and replaces links by links between roots. Vertices that still have links at least
    halve, so rounds grow with the logarithm of the longest chain. Minima are combined before each shuffle,
    links between roots are made distinct, and no vertex's neighbours meet in one task.
    """
    edges = save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    members = None
    while not edges.isEmpty():
        # every vertex but local minima gets its smallest neighbour as parent
        up = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        roots = _jump(save(up, "hooks"))
        members = roots if members is None else save(
            members.join(roots.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left")
            .select("id", F.coalesce("top", "up").alias("up"))
            .unionByName(roots), "members")
        left, right = (roots.select(F.col("id").alias(c), F.col("up").alias(f"r{c}")) for c in "ab")
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = save(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if members is None:
        return links.where("a <> b").select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    tops = members.select(F.col("up").alias("id")).distinct()
    return members.unionByName(tops.withColumn("up", F.col("id"))).select("id", F.col("up").alias("component"))
