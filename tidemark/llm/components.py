"""Connected components as joins and minimum aggregates over an edge table (large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, store


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small star; ``loose`` marks edges beside the one that each ``u`` keeps, which may come again."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    moved = edges.select("u", "v").join(low, "v").select("u", F.col("m").alias("v")).distinct()
    low = moved.groupBy("u").agg(F.min("v").alias("m"))
    loose = F.col("v") != F.col("m")
    return moved.join(low, "u").select(F.when(loose, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), loose.alias("loose"))


def _jump(edges: DataFrame) -> DataFrame:
    """Where each ``u`` has one edge: to the end that its ``v`` has."""
    up = edges.select(F.col("u").alias("v"), F.col("v").alias("m"))
    return edges.select("u", "v").join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.lit(False).alias("loose"))


def _stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one edge and is no ``v``: the components are found."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node of its component.

    ``edges`` is read several times: give a stored table. Each round is two minimum aggregates (combined before the shuffle, so
    a hub costs one row a task) and two joins that Spark may split on hot keys; once every node has one edge, one join shortens
    the ways that are left. Edges that are stars already take no round. Edges are stored between rounds, only counts come to the
    driver. Self links, repeated and reversed edges are allowed; no edge gives no row.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    done, step = _stars(now), _round
    if not done:
        now = store(now.distinct(), "edges")
    while not done:
        last, now = now, store(step(now), "edges")
        discard(last)
        if now.where("loose").agg(F.count("*")).first()[0]:
            step = _round
        else:
            done, step = _stars(now), _jump
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
