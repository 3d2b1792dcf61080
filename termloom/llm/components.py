"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize


def _linked_to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with v in reach of u: every v and u itself point to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b); the component is its least vertex.

    Each round is two groupings and two joins over at most the edge count; a hot vertex has
    its minimum pre-aggregated and its join split by the adaptive planner.  The rounds are
    written to the shared folder.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        down = _linked_to_least(large)
        small = (
            down.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        current = materialize(small)
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    least = current.select(F.col("v").alias("vertex")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        least.select("vertex", F.col("vertex").alias("component"))
    )
