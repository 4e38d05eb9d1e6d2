"""Distances in graphs of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.shared import stored


def bounded_distances(edges: DataFrame, target: int, *, most: int = 4, directed: bool = False) -> DataFrame:
    """(id, distance): the least number of steps, ``most`` at most, from the target to each node that it reaches; not the target.

    Edges are (id1, id2). Undirected they count both ways. Directed, nodes with an edge to the target are one step away, and from
    them distances spread along the edges, from id1 to id2. Every turn joins the nodes found last with the edges once, and its
    result is written, so a turn's plan doesn't grow.
    """
    forward, back = (edges.select(F.col(a).alias("at"), F.col(b).alias("next")).where("at <> next") for a, b in (("id1", "id2"), ("id2", "id1")))
    both = stored((forward if directed else forward.unionByName(back)).distinct())
    start = back if directed else both
    found = start.where(F.col("at") == target).select(F.col("next").alias("id"), F.lit(1).alias("distance")).distinct()
    front = found = stored(found)
    for step in range(2, most + 1):
        near = front.join(both, front["id"] == both["at"]).select(F.col("next").alias("id")).where(F.col("id") != target).distinct()
        front = stored(near.join(found, "id", "left_anti").select("id", F.lit(step).alias("distance")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
