"""Connected components of a graph of links, by stars: every round is a few shuffles of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node at hand."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b): ``root`` is the smallest node that can be reached.

    Large and small stars alternate until no link changes; links of a node are never gathered, and each round is
    written, so that its lineage ends there. Links of a node to itself count for nothing.
    """
    links = stored(links.where("a != b").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        links = stored(_small_star(_large_star(links).distinct()).distinct(), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
