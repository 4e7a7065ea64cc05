"""Checkpoints, row numbers and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is set if Spark runs in one process, as in tests; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def one_per(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of the key (repeated rows of an id count once); null keys go."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has two columns of one orderable type, the ends; loops and nulls are ignored. Returns (node, component): the
    least node of each component, for every node with an edge to another. Each round moves edges by node, with the
    minimum aggregated before the shuffle and joined back, so that a hub's rows can be split; the number of
    rounds grows with the logarithm of the longest path. Nothing is collected but a count and a checksum.
    """
    x, y = edges.columns
    e = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct()
    e = spool(e, "edges")
    before = _checksum(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
        e = spool(small.select(F.col("s.b").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct(), "edges")
        after = _checksum(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
