"""Connected components of a link table, distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014) in joins and minimum aggregates, each result written
to the shared folder. No neighbour list is gathered: a hub's links are reduced by a
partial ``min`` before the shuffle and re-joined, where adaptive execution can split
the hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm.store import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 64) -> DataFrame:
    """Label every node that has a link.

    ``edges`` has long columns ``u`` and ``v``; nulls and self-links are ignored, direction and
    repeats do not matter. Returns ``node``, ``component`` (the smallest node reachable).
    An empty table gives an empty table.
    """
    made = []

    def write(df: DataFrame, step: str) -> DataFrame:
        made.append(f"{name}-{step}")
        return scratch.write(df, made[-1])

    now = write(edges.select("u", "v").where("u <> v").distinct(), "0")
    for k in range(1, most_rounds + 1):
        both = _both(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = write(large, f"{k}-large")
        # every edge now points from a larger node (u) to a smaller one (v)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        small = write(small, f"{k}-small")
        # done when every node points to one node, which points nowhere itself
        counts = small.groupBy("u").agg(F.count("*").alias("n"))
        targets = small.select(F.col("v").alias("u")).distinct()
        if not counts.where("n > 1").unionByName(counts.join(targets, "u", "left_semi")).head(1):
            now = small
            break
        now = small
        scratch.drop(*made[:-1])
        del made[:-1]
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    scratch.drop(*made[:-1])
    roots = now.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
