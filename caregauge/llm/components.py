"""Connected components of link tables by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregauge.llm.common import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least one of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes that a link (u, v) of different longs touches; ``root`` is the
    least node of the component, and has no row of its own.

    Each round is written to the shared folder, so that no lineage grows and a lost executor costs
    its tasks alone; rounds end when the links no longer change (their number grows with the
    logarithm of the longest path). Hot nodes are aggregated before they move, and the least
    neighbours are written too, so that adaptive execution can split the joins of hot nodes.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links = written(links)
    state = _state(links)
    while state[0]:
        links = written(_small_star(_large_star(links)))
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
