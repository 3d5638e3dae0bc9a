"""Joins and connected components that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are heavy, whatever the data; their rows are what is broadcast.
HEAVY = 2048


def weight_limit(rows: int) -> int:
    """Rows from which a key is heavy: of so many rows at most HEAVY keys can be."""
    return max(256, -(-rows // HEAVY))


def join_by_weight(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, limit: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with keyed, which has one row a key and in ``weight`` how many rows have it.

    Keys of more than ``limit`` rows are joined where their rows lie: with ``weight_limit`` there are at
    most HEAVY of them, so the broadcast is bounded and no task gets all rows of a heavy key.
    """
    heavy = keyed.where(F.col(weight) > limit).drop(weight)
    light = keyed.where(F.col(weight) <= limit).drop(weight)
    in_place = rows.join(F.broadcast(heavy), keys)
    others = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return in_place.unionByName(others)


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_by_weight(both, least, ["a"], "n", limit).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_by_weight(down, least, ["a"], "n", limit).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(id, component) for every node in edges(a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): minima and joins over the edge
    table, of which ``keep`` writes each round and ``drop`` may delete the one before.  No node's
    neighbours are gathered in one task.  Self-loops, repeated edges and both directions are allowed;
    rows with a null are ignored; nodes without an edge to another node do not appear.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state or not seen["n"]:
            break
        state = (seen["n"], seen["h"])
        was, limit = now, weight_limit(2 * seen["n"])
        large = keep(_large_star(now, limit).distinct())  # written, so that the next plan reads it once and not for each of its uses
        now = keep(_small_star(large, limit).distinct())
        if drop is not None:
            drop(was)
            drop(large)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
