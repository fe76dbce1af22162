"""Connected components by contraction; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in `links` (a, b: long): columns id, component.

    Every round each id points to its least neighbour, pointers are doubled until they rest on
    roots, and links are redrawn between roots; the rounds are about the logarithm of the longest
    path. Null ends, loops and repeated links change nothing. Only minima per id are gathered,
    and each round's table is cut out of its lineage.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(links)
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")))
        while True:
            beyond = points.select(F.col("id").alias("to"), F.col("to").alias("far"))
            doubled = points.join(beyond, "to").select("id", F.col("far").alias("next"), "to")
            doubled = cut(doubled)
            moved = not doubled.where("next <> to").isEmpty()
            points = doubled.select("id", F.col("next").alias("to"))
            if not moved:
                break
        root = points.select(F.col("id").alias("component"), "to")
        if labels is None:
            labels = points.select("id", F.col("to").alias("component"))
        else:
            labels = cut(labels.join(root, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        a = points.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        b = points.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        links = cut(links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
