"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.store import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``(u, root)`` for every node of ``edges(a, b)``; the root is its component's least node.

    Alternates two star contractions: each node hands its larger neighbours,
    then its smaller ones, to the least node that it knows.  Both are an
    aggregate of one minimum per node (combined before the shuffle) and an
    equi-join whose skew AQE can split, so a hub of any degree is harmless.
    The rounds grow with the logarithm of the longest chain.  Each round is
    written, so that a lost executor repeats one round at most.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{folder}/edges-0",
    )
    state, turn = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state, turn = mark, turn + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        now = written(small, f"{folder}/edges-{turn}")
    nodes = now.select("u", F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)
