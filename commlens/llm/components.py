"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import forget, written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps: every node's neighbours are linked to
    the smallest one, so the number of edges never grows and the number of rounds is
    logarithmic in the longest chain.  Each round is written to the shared folder, so a
    lost executor costs one round at most.  Joins are between a node and its minimum, and
    the minimum is pre-aggregated: a node with very many neighbours is no hot key.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the smallest of the node and its neighbours
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest one
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small_low.select("a", F.col("m").alias("b")))
        links, old = written(small.where("a <> b").distinct()), links
        forget(old)
        # one row of figures: edges, and a fingerprint of them
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
