"""Connected components of a table of links, by alternating star steps.

Each step is a grouped minimum (combined before the shuffle) and one join; the
links of a step are written to the shared folder, so lineage stays short and a
lost executor costs one step. The number of steps grows with the logarithm of
the longest chain. A node with very many links is a skewed join key, which
adaptive execution splits; nothing is gathered per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import written

MOST_STEPS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the smallest one of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get linked to the smallest of them; links are ``a < b``."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component`` for every node that has a link; ``component`` is the smallest node reached.

    ``links`` has columns ``a, b`` of one integer type; loops, repeats and either
    direction are allowed, rows with a null are not links.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = written(ordered.filter("a < b and a is not null").distinct(), purpose)
    state = None
    for _ in range(MOST_STEPS):
        now = written(_small_star(_large_star(now)), purpose)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"no end after {MOST_STEPS} steps")
    # Every link is now from a component's smallest node.
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("component")))
