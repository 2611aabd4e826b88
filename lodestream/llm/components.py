"""Connected components by alternating large-star and small-star steps, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node of it) of all nodes of the links ``a, b``; ids are comparable and not null.

    Minima are aggregated before they are joined, so a node with very many links is no hot group.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        large = both.where(F.col("v") > F.col("u")).join(_least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        star = large.join(_least(large), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(_least(large).withColumnRenamed("m", "v"))
        new = materialize(star.where(F.col("u") != F.col("v")).distinct(), "links")
        discard(now)
        now = new
        sign = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
