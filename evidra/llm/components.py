"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidra.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component.

    ``edges`` has columns a and b, in any direction, with repeats and loops. A round first hangs each
    node's larger neighbours on its smallest one, then its smaller neighbours too; the number of rounds
    follows the logarithm of the longest chain. Rounds end when the edges no longer change.
    """
    state = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(state)
    while True:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        last, mark = mark, _mark(state)
        if mark == last:
            roots = state.select(F.col("v").alias("node")).distinct()
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())
