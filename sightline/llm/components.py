"""Connected components by alternating large-star and small-star steps, as joins and grouped minima.

No node's neighbours are gathered in one row: a step takes the least neighbour of every node (a grouped minimum with
map-side partial results) and points the edges at it. Edges that occur twice, loops and nulls are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import materialize, release

#: Far more than the logarithmic number of rounds that the method needs.
MOST_ROUNDS = 100


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    # written, so that the join of a hub's edges with it has two plain sides and can be split over tasks
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both)
    stars = both.join(least, "u").where("v > u")
    out = materialize(stars.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct(), "edges")
    release(edges, least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    # edges come with u > v
    least = _least_neighbour(edges)
    stars = edges.join(least, "u")
    out = materialize(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    release(edges, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) the rows (node, root) of every node that has an edge; root is its component's least node."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = materialize(now, "edges"), None
    for _ in range(MOST_ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
        now = _small_star(_large_star(now))
    raise RuntimeError("components did not settle")
