"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import staged


def _rooted(parents: DataFrame) -> DataFrame:
    """(v, p) with every p a root: pointers are doubled until none moves.

    Only vertices that are not roots are in the table, so a pointer at a root finds no partner and stays.
    """
    while True:
        hop = parents.select(F.col("v").alias("p"), F.col("p").alias("_up"))
        moved = staged(
            parents.join(hop, "p", "left").select(
                "v", F.coalesce("_up", "p").alias("p"), F.col("_up").isNotNull().alias("_moved")
            ),
            "union-find-jump",
        )
        parents = moved.select("v", "p")
        if moved.where("_moved").isEmpty():
            return parents


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (vertex, root) for every vertex of an edge; the root is its component's smallest vertex.

    Each round hooks every vertex to its smallest neighbour (a minimum with map-side partial sums, so a hub costs
    one row per task), doubles the pointers until they end at roots and contracts the edges to roots. At least
    half of the remaining vertices vanish per round. Repeated edges are fine; loops and null ends are ignored; no
    edges give an empty table. Every round is a written table, so a lost executor replays one round only.
    """
    live = staged(
        edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "union-find-edges",
    )
    roots = live.select(F.col("a").alias("vertex"), F.col("a").alias("root"))  # empty unless a round is run
    first = True
    while not live.isEmpty():
        hooks = staged(live.groupBy("b").agg(F.min("a").alias("p")).withColumnRenamed("b", "v"), "union-find-hooks")
        parents = _rooted(hooks)
        if first:
            tops = live.select(F.col("a").alias("v")).distinct().join(parents, "v", "left_anti")
            found = parents.unionByName(tops.select("v", F.col("v").alias("p")))
            roots, first = staged(found.select(F.col("v").alias("vertex"), F.col("p").alias("root")), "union-find"), False
        else:
            step = parents.select(F.col("v").alias("root"), F.col("p").alias("_next"))
            roots = staged(
                roots.join(step, "root", "left").select("vertex", F.coalesce("_next", "root").alias("root")), "union-find"
            )
        ends = live
        for end in ("a", "b"):
            step = parents.select(F.col("v").alias(end), F.col("p").alias("_next"))
            ends = ends.join(step, end, "left").withColumn(end, F.coalesce("_next", end)).drop("_next")
        live = staged(
            ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "union-find-edges",
        )
    return roots
