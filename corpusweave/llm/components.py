"""Connected components by min-label propagation with pointer jumping; every round is cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, forget


ROWS_PER_FILE = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, comp): comp is the smallest node reachable; nodes without edges don't appear.

    Rounds of large-star and small-star: each moves links towards the least node of a neighbourhood, so the number of
    rounds grows with the logarithm of a component's size, and a hub's links are combined before the shuffle (min()).
    Null and self links are dropped; no links give no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, before = _settled(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large-star: every larger neighbour of a node goes to the node's least neighbour (or itself)
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: every smaller neighbour, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new, now = _settled(small, before[0])
        forget(links)
        links, done, before = new, now == before, now
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("comp")))


def _settled(links: DataFrame, expected: int = 0) -> tuple[DataFrame, tuple[int, int]]:
    """links cut to the shared folder, in files of about ROWS_PER_FILE, with their count and a sum of hashes to compare rounds by."""
    out = cut(links, "cc", parts=expected // ROWS_PER_FILE + 4 if expected else None)
    n, h = out.agg(F.count("*"), F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 24))).first()
    return out, (n, h or 0)
