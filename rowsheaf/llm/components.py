"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsheaf.plans.files import materialise


def _digest(links: DataFrame) -> tuple:
    """Tells one set of links from another."""
    own = F.xxhash64("src", "dst").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(own), F.sum(F.col("dst").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, label: str) -> DataFrame:
    """``node, component`` for each node of ``links`` (``src``, ``dst``, long): the smallest node it can reach.

    Each round links every node's neighbours to the smallest of them, first the larger, then the smaller
    neighbours, until nothing changes: a logarithmic number of rounds, all state in tables. Minima are
    taken before the shuffle and stars are never paired, so a node with very many links costs its links only.
    """
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = materialise(links.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), label)
    nodes = both(edges).select(F.col("src").alias("node")).distinct()
    seen = _digest(edges)
    while True:
        # large step: every larger neighbour of a node goes to the smallest of the node and its neighbours
        around = both(edges)
        least = around.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
        large = around.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        large = materialise(large.distinct(), label)
        # small step: every smaller neighbour of a node, and the node, go to the smallest of them
        least = large.groupBy("src").agg(F.min("dst").alias("least"))
        joined = large.join(least, "src")
        small = joined.where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        small = small.union(least.select("src", F.col("least").alias("dst"))).where("src != dst")
        small = materialise(small.distinct(), label)
        edges, before, seen = small, seen, _digest(small)
        if seen == before:
            break
    return nodes.join(edges.withColumnRenamed("src", "node"), "node", "left").select(
        "node", F.coalesce("dst", "node").alias("component")
    )
