"""Connected components of a link table by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.llm.common import discard, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (a > b), which are discarded. Large: every larger neighbour of a node links to the node's least neighbour.
    Small: every smaller neighbour and the node itself link to the least one."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join reads plain exchanges and a hub's rows can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = written(out.where("a > b").distinct(), "links")
    discard(links, least)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: columns a, b of one orderable type. Returns node, component (the least node reachable) for every node
    of a link; nulls and loops are ignored. Nothing is collected but two sums a round. Each round's links are a
    written table, so a lost executor costs one task. Needs O(log^2 n) rounds."""
    now = written(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(rounds):
        stamp = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if stamp[0] == 0 or tuple(stamp) == before:
            break
        before = tuple(stamp)
        now = _star(_star(now, large=True), large=False)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
