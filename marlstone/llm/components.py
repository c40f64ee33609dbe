"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread_join


#: Edges (16 bytes each) that one task of a round takes. Graphs shrink to few edges; dealt to all partitions of the
#: session, these would be rounds of empty tasks and files.
TASK_EDGES = 100_000


def _both(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(ends))


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars around smallest nodes: those with two
    smaller neighbours, or with a smaller and a larger one."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("below")), F.struct(F.col("v").alias("node"), F.lit(1).alias("below")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n"))
    loose = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("n") > F.col("below")))
    n, found = nodes.agg(F.sum("below"), F.count_if(loose)).first()
    return n or 0, found


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """``n``: number of edges. The centre of a large star is a hot key, so its edges are dealt by their other end.
    Repeated edges stay, no more than there were; the small star takes them out."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(both, least, ["u"], "n", 2 * n, "v").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    found = edges.join(edges.groupBy("v").agg(F.min("u").alias("m")), "v")
    moved = F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v")))
    return found.select(F.inline(moved)).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), the component being its smallest node.

    Null ends, loops and repeated edges are allowed and mean nothing. A star leaves the graph's
    components as they are; the rounds end when all edges are stars around smallest nodes."""
    least, most = F.least("u", "v"), F.greatest("u", "v")
    edges = checkpoint(edges.where("u is not null and v is not null and u <> v").select(least.alias("u"), most.alias("v")).distinct())
    n, loose = _state(edges)
    while loose:
        edges = edges.coalesce(n // TASK_EDGES + 1)
        edges = checkpoint(_small_star(_large_star(edges, n)))
        n, loose = _state(edges.coalesce(n // TASK_EDGES + 1))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
