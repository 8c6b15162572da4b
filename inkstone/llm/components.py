"""Connected components as DataFrames; nothing but one number a round reaches the driver. keep: writes a table and reads it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def stars(edges: DataFrame, keep: Callable = keep) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node but the smallest ones.

    Alternating large and small stars; the number of rounds grows with the logarithm of the longest path.
    """
    now = keep(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = keep(_small_star(_large_star(now)), "edges")
        new = _mark(after)
        if new == mark:
            break
        now, mark = after, new
    return now


def connect(labels: DataFrame, links: DataFrame, keep: Callable = keep) -> DataFrame:
    """Labels (node, label) after links (a, b) between nodes; a label is the smallest node of its component."""
    x, y = labels.alias("x"), labels.alias("y")
    between = links.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    edges = between.select(F.col("x.label").alias("u"), F.col("y.label").alias("v"))
    moved = stars(edges, keep)
    joined = labels.join(moved, labels["label"] == moved["u"], "left")
    return joined.select("node", F.coalesce("v", "label").alias("label"))
