"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v), u != v: links every v to the smallest node around its u, counting u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of its component for every node of a link; links with nulls or to itself are ignored.

    Stars never gather neighbours in one row; each round is two aggregations and two joins and is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    links = links.filter(f"{a} is not null and {b} is not null and {a} != {b}")
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _star(large)
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        nxt = materialise(nxt, "links")
        new = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = nxt
        if state == tuple(new):
            break
        state = tuple(new)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
