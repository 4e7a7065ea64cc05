"""Adapters from relational tables to the document model: path, title, texts, present and spanning edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import scalar_text, texts_map


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_documents(df: DataFrame, path: Column, fields: list[str], multi: dict[str, Column] | None = None) -> DataFrame:
    """(path, texts, present): a row is a document whose fields are the given columns; ``multi`` adds fields that are arrays of texts."""
    made = {f: F.array(scalar_text(F.col(f), df.schema[f].dataType)) for f in fields} | (multi or {})
    present = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields), *map(F.lit, multi or {})))
    return df.select(path.alias("path"), texts_map(made).alias("texts"), present.alias("present"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, ord): root -> region -> nation -> customer -> order as a spanning relation."""
    path = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    rows = [
        region.select(F.lit("root").alias("source"), path("region", "r_regionkey").alias("target"), F.col("r_regionkey").cast("long").alias("ord")),
        nation.select(path("region", "n_regionkey").alias("source"), path("nation", "n_nationkey").alias("target"), F.col("n_nationkey").cast("long").alias("ord")),
        customer.select(path("nation", "c_nationkey").alias("source"), path("customer", "c_custkey").alias("target"), F.col("c_custkey").alias("ord")),
        orders.select(path("customer", "o_custkey").alias("source"), path("order", "o_orderkey").alias("target"), F.col("o_orderkey").alias("ord")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ord, target_text): the href targets of each page, in order."""
    pages = read(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("source"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "target_text"))
    return found.select("source", F.col("ord").cast("long").alias("ord"), "target_text")
