"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lookup, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with m, the least of u and its v; and the staged table that this reads."""
    least = stage(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")).withColumn("m", F.least("u", "m")), "components-least")
    return lookup(rows, least, ["u"], "__n", rows.count()), least


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v) edges -> (node, label): the least node of each component, for every node that has an edge.

    Each round is two grouped minima, written to the shared folder; the number of rounds grows with the logarithm
    of the number of nodes. Loops and repeated edges do no harm; without edges the result is empty."""
    at = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "components")
    mark = _mark(at)
    for _ in range(most):
        if not mark[0]:
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with_least, least = _with_least(both)
        large = stage(with_least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "components")
        small, least2 = _with_least(large)
        new = stage(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "components")
        drop(at, large, least, least2)
        at, before = new, mark
        mark = _mark(at)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {most} rounds")
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
