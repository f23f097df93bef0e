"""Iterating a relation to its fixpoint with bounded lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared checkpoint folder."""
    ensure_folder(df.sparkSession)
    return df.checkpoint()


def ensure_folder(spark: SparkSession) -> None:
    """Reads the cluster's setting; names a folder of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)


#: Shuffle files go when the query that wrote them ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """Writes an intermediate result as columns, of which readers take what they need, to the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast if counted to be small, as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def least_reachable(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: the least node that undirected edges reach; isolated nodes are absent.

    Each turn takes the least label among neighbours and then the label's own
    label, so that chains shrink by half.  Minima are combined before the
    shuffle; hubs are joins that AQE can split.
    """
    both = settled(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).where("x <> y").distinct())
    labels = settled(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jump = step.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        after = settled(jump.select("node", F.least("root", F.coalesce("next", "root")).alias("root")))
        if after.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").isEmpty():
            return after
        labels = after


def follow(pairs: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root`` by following ``parent`` until it is null or unknown; chains halve each turn.

    A cycle keeps the last node reached after as many turns as a chain of all
    rows would need.
    """
    now = settled(pairs.select(F.col(node).alias("node"), F.coalesce(F.col(parent), F.col(node)).alias("root")))
    known = now.select("node")
    now = settled(now.join(known.withColumnRenamed("node", "root").withColumn("_known", F.lit(True)), "root", "left").select("node", F.when(F.col("_known"), F.col("root")).otherwise(F.col("node")).alias("root")))
    turns = max(1, int(now.count()).bit_length())
    for _ in range(turns):
        after = settled(now.join(now.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")))
        if after.join(now.withColumnRenamed("root", "before"), "node").where("root <> before").isEmpty():
            return after
        now = after
    return now
