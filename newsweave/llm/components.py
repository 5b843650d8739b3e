"""Connected components of a large graph by contraction, with every step stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.session import checkpointed, forget


def _roots(parents: DataFrame) -> DataFrame:
    """(a, parent) -> (a, parent) with the root of each vertex: the way to it is halved in every step."""
    while True:
        above = parents.select(F.col("a").alias("parent"), F.col("parent").alias("above"))
        moved = checkpointed(parents.join(above, "parent").select("a", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        still = moved.where("moved").isEmpty()
        forget(parents)
        parents = moved
        if still:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` has columns a and b (long, in either direction, repeats allowed).  Returns (vertex, component), the component being its
    smallest vertex.

    In each round every vertex hooks to its first neighbour if that comes before itself, the trees are contracted to one vertex each, and edges inside a tree vanish.
    The first round takes vertices in their own order, which contracts chains and stars of ascending ids at once.  Later rounds take a new pseudo-random
    order each: a vertex with a neighbour stays a root with a probability of one half at most, so the number of rounds is logarithmic for any graph.  A vertex with very many
    edges only makes long sides of joins whose other side has one row for it."""
    e = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = checkpointed(e.select(F.col("a").alias("vertex")).distinct().withColumn("component", F.col("vertex")), "labels")
    turn = 0
    while not e.isEmpty():

        def place(vertex: str) -> Column:
            return F.struct((F.col(vertex) if turn == 0 else F.xxhash64(vertex, F.lit(turn))).alias("place"), F.col(vertex).alias("vertex"))

        parents = _roots(checkpointed(e.groupBy("a").agg(F.least(place("a"), F.min(place("b")))["vertex"].alias("parent")), "parents"))
        if turn:  # a tree is named after its smallest vertex
            names = parents.groupBy("parent").agg(F.min("a").alias("name"))
            renamed = checkpointed(parents.join(names, "parent").select("a", F.col("name").alias("parent")), "parents")
            forget(parents)
            parents = renamed
        moved = parents.select(F.col("a").alias("component"), F.col("parent").alias("to"))
        new_labels = checkpointed(labels.join(moved, "component", "left").select("vertex", F.coalesce("to", "component").alias("component")), "labels")
        to_a, to_b = parents.select("a", F.col("parent").alias("pa")), parents.select(F.col("a").alias("b"), F.col("parent").alias("pb"))
        new_edges = checkpointed(e.join(to_a, "a").join(to_b, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        forget(e, labels, parents)
        e, labels, turn = new_edges, new_labels, turn + 1
    forget(e)
    return labels
