"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import forget, join_each, stored


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) of *total* with the least of u and all of u's neighbours as m; a hub's edges stay where they are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")).select("u", F.least("u", "m").alias("m"), "__n")
    return join_each(edges, least, "u", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """As many edges as before."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    met = _with_least(edges, total)
    one = F.array(F.struct("u", F.col("m").alias("v")), F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return met.select(F.inline(F.array_compact(one))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another node; component is its least node.

    The stars take O(log^2 n) rounds; each is stored, so nothing is computed
    twice and a lost executor costs one round at most; a round's files go when
    the next is there.  Null ends and loops are left out.  Raises RuntimeError if
    *rounds* do not suffice.
    """
    a, b = F.col(left), F.col(right)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = seen
        large = stored(_large_star(now, seen[0]), "stars")
        small = stored(_small_star(large, seen[0]), "stars")
        forget(now, large)
        now = small
    raise RuntimeError(f"components are not settled after {rounds} rounds")
