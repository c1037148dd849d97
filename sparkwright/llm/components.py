"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import storage


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every id in ``links (a, b)``; the component is its smallest id.

    Contraction: each vertex joins the neighbour of least hashed rank, if that
    ranks below itself, and edges are relabelled; hashed ranks make the number
    of rounds logarithmic for any shape.  Every round is two aggregations and
    joins written to the shared folder, so nothing grows in the driver or in
    the lineage.  Neighbours are reduced by a map-side minimum, so a hub costs
    no more than its edges.  Self-links, repeated links and links with a null
    are ignored; an empty table gives an empty one.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    pairs = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = storage.keep(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    names = storage.keep(edges.select(F.col("a").alias("id")).distinct().withColumn("at", F.col("id")), "names")
    while not edges.isEmpty():
        near = edges.groupBy("a").agg(F.min(rank("b")).alias("n"))
        hop = storage.keep(near.select("a", F.least(F.col("n"), rank("a"))["v"].alias("p")), "hop")
        twice = hop.select(F.col("a").alias("p"), F.col("p").alias("q"))
        root = storage.keep(hop.join(twice, "p").select("a", "q"), "root")
        storage.drop(hop)
        moved = (
            edges.join(root, "a").select(F.col("q").alias("x"), F.col("b").alias("a")).join(root, "a")
            .where("x <> q").select(F.col("x").alias("a"), F.col("q").alias("b")).distinct()
        )
        renamed = names.join(root.withColumnRenamed("a", "at"), "at", "left").select("id", F.coalesce("q", "at").alias("at"))
        old = (edges, names, root)
        edges, names = storage.keep(moved, "edges"), storage.keep(renamed, "names")
        for x in old:
            storage.drop(x)
    storage.drop(edges)
    least = names.groupBy("at").agg(F.min("id").alias("component_id"))
    return names.join(least, "at").select("id", "component_id")
