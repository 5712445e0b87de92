"""Connected components of a link table, as joins and aggregates.

Alternates the large-star and small-star steps: each links a node's neighbours
to the least of them. Link rows never grow in number beyond the input, hub nodes
are dealt with by aggregates, and the rounds are logarithmic in the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to its least neighbour."""
    if large:
        both = links.union(links.select("b", "a"))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a and b of one type); the component
    is the least node that can be reached. Links of a node with itself and
    repeated links change nothing; null ends are left out."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = kept(links, "cc")
    state = None
    for _ in range(MAX_ROUNDS):
        links = kept(_star(_star(links, True), False), "cc")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
