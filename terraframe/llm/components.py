"""Connected components of an edge table, distributed.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
is two grouped minima and joins, hubs shrink to stars, and the number of rounds
grows with the logarithm of the largest component.  Edges never leave the
executors; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_table, join_split, write_table


def connected(edges: DataFrame, name: str = "components", rounds: int = 60, parts: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the smallest node reachable.

    It reads a written table, which drop_table() deletes.  Self-loops, repeated and reversed edges are allowed; nulls
    are ignored; an empty table gives an empty result.  The rows of a hub are
    split in the joins; its minima are pre-aggregated.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = write_table(edges, f"{name}-0", parts=parts)
    mark = None
    for i in range(rounds):
        # large-star: the larger neighbours of a node go to its least neighbour
        least = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        star = join_split(edges, least, ["b"]).select("a", F.col("m").alias("b"))
        # small-star: the smaller neighbours of a node, and itself, go to the least of them
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        small = join_split(star, least, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        new = write_table(small, f"{name}-{i + 1}", parts=parts)
        drop_table(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    # settled: every node points at its root
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    out._table_path = edges._table_path  # what drop_table() deletes
    return out
