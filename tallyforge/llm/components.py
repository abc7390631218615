"""Connected components of a link table, by alternating large-star and small-star steps.

Every step groups by node and takes a minimum, so a node with very many links is combined map-side; the join that
hands the minimum back splits such a node's rows (AQE's skew join). A step's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    moved = down.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the component's least node.

    links: two columns of one orderable type; order, repeats and self-links don't matter; rows with a null are left out.
    """
    u, v = links.columns
    links = links.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b").distinct()
    now = stash(links, "links")
    state = _state(now)
    while state[0]:
        then, before = now, state
        now = stash(_small_star(_large_star(then).distinct()).distinct(), "links")
        state = _state(now)
        unstash(then)
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
