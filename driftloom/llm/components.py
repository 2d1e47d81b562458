"""Connected components of a distributed edge list by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of an edge; the smallest nodes themselves aren't listed.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest (large star, small star), until
    every component is a star: a number of rounds logarithmic in the longest path, each two joins on shuffled edges
    whose hot nodes are split as skewed joins are. Null ends and loops are left out."""
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(pairs.filter(pairs[2]).select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        best = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(best, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        now = materialise(small.unionByName(best.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first())
