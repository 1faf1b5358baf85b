"""Connected components by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From edges (a, b) of longs: (v, comp) for every vertex of an edge between two vertices, comp its component's least vertex.

    Every round gives each vertex the least of itself and its neighbours, replaces edges by edges between
    these, and drops loops and repeats, until none is left; stars go in one round and paths by halves or
    better. A hub is one row of a partial minimum from each task, and one side of joins with written tables
    that Spark splits.
    """
    edges = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        to = scratch.table(both.groupBy("v").agg(F.least("v", F.min("u")).alias("p")))
        a, b = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        old, edges = edges, scratch.table(moved)
        scratch.drop(old)
        if label is None:
            label = to.select("v", F.col("p").alias("comp"))
        else:
            label = scratch.table(label.join(to.select(F.col("v").alias("comp"), "p"), "comp", "left").select("v", F.coalesce("p", "comp").alias("comp")))
    return label if label is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))
