"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut

#: Edges for a task to read, at least, before they are shuffled.
EDGES = 1 << 17


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbours and itself; a row for each row at most."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them. Edges point from larger to smaller."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (id, label): for every node with an edge to another node, the least node that it reaches.

    Stars are joins on a node and sums by node that combine before they are shuffled, so a node with very many neighbours
    does not gather them in one place. Self-links and rows with a null end count for nothing. Every step's edges are kept
    in the shared folder, in as many files as their number asks for, so a round over few edges writes few; the loop ends
    when a round leaves them as they were.
    """
    now = edges.where("u <> v").select("u", "v")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while True:
        files = max(1, seen[0] // EDGES)
        wide = cut(large_star(now.coalesce(files)).coalesce(files))
        now = cut(small_star(wide).coalesce(files))
        if (then := mark(now)) == seen:
            break
        seen = then
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
