"""Connected components of an edge table, by alternating large and small stars.

Each round hooks the neighbours of a node to the smallest of them (large star: greater neighbours;
small star: the others) and is written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  Rounds grow with the logarithm of the component, and a node with
very many neighbours is pre-aggregated to its minimum before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.llm.scratch import store


def _hook(edges: DataFrame) -> DataFrame:
    """Edges (child a, parent b) after a large and a small star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); the label is the smallest node of its component."""
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def sign(table: DataFrame) -> tuple:
        row = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row.n, row.s

    before, last = None, sign(now)
    while before != last:
        now, before = store(_hook(now), "edges"), last
        last = sign(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
