"""Repairs offered for findings, as rows (kind, doc, offer, warrant, detail, rank); none is applied here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, folder, resolve
from ..functions.values import near

#: Fixed values. kind -> offers as (offer, warrant), in order. Kinds without a row are diagnosis only.
FIXED = {
    "missing_inverse": (("link", "derived"),),
    "id_mismatch": (("trust_registry", "judgment"), ("trust_document", "judgment")),
    "unregistered_id": (("trust_document", "derived"),),
    "unstamped_id": (("trust_registry", "derived"),),
    "fixity_mismatch": (("restamp", "judgment"),),
    "stale_label": (("relabel", "derived"),),
    "about_stale": (("regenerate", "derived"),),
    "manifest_drift": (("regenerate", "judgment"),),
    "manifest_mismatch": (("regenerate", "judgment"),),
    "malformed_id": (("remove_link", "destructive"),),
    "dangling_id": (("remove_link", "destructive"),),
    "duplicate_containment": (("reparent", "judgment"), ("remove_link", "destructive")),
    "missing_containment": (("adopt", "derived"),),
    "unknown_term": (("add_term", "judgment"),),
    "term_near_miss": (("set_term", "judgment"), ("add_term", "judgment")),
}


def fixed_offers(findings: DataFrame) -> DataFrame:
    """The offers that follow from a finding's kind alone."""
    rows = [(kind, offer, warrant, rank) for kind, offers in FIXED.items() for rank, (offer, warrant) in enumerate(offers)]
    table = findings.sparkSession.createDataFrame(rows, "kind string, offer string, warrant string, rank int")
    return findings.join(F.broadcast(table), "kind").select("kind", "doc", "offer", "warrant", "detail", "rank")


def retargets(broken: DataFrame, files: DataFrame, most: int = 2) -> DataFrame:
    """For broken links (source, target_text): files of the target's folder whose name is one or two edits away, nearest first, then removal."""
    wanted = broken.select("source", "target_text", resolve(F.col("source"), F.col("target_text")).alias("path")).distinct()
    wanted = wanted.withColumns({"dir": folder(F.col("path")), "name": file_name(F.col("path"))})
    there = files.select(folder(F.col("path")).alias("dir"), file_name(F.col("path")).alias("candidate"), F.col("path").alias("to"))
    # Names are compared with those of nearly their length only.
    wanted = wanted.withColumn("size", F.explode(F.sequence(F.length("name") - most, F.length("name") + most)))
    pairs = wanted.join(there.withColumn("size", F.length("candidate")), ["dir", "size"]).withColumn("distance", near(F.col("name"), F.col("candidate"), most)).where("distance IS NOT NULL")
    found = pairs.select(F.lit("broken_link").alias("kind"), F.col("source").alias("doc"), F.lit("retarget").alias("offer"), F.lit("judgment").alias("warrant"), F.concat_ws(" -> ", "target_text", "to").alias("detail"), F.col("distance").cast("int").alias("rank"))
    removal = broken.select(F.lit("broken_link").alias("kind"), F.col("source").alias("doc"), F.lit("remove_link").alias("offer"), F.lit("destructive").alias("warrant"), F.col("target_text").alias("detail"), F.lit(most + 1).alias("rank"))
    return found.unionByName(removal.distinct())


def adoptions(orphans: DataFrame, containers: DataFrame) -> DataFrame:
    """For orphans (path): the containers (path) of the nearest folder above that has any, and those of the root, each once."""
    from ..functions.paths import ancestors

    homes = containers.select(F.col("path").alias("container"), folder(F.col("path")).alias("home"))
    above = orphans.select("path", F.explode(F.array_append(ancestors(folder(F.col("path"))), F.lit(""))).alias("home")).distinct()
    # Folders meet before their containers do, so that an orphan has two rows of folders at most.
    kept = above.join(homes.select("home").distinct(), "home").groupBy("path").agg(F.max_by("home", F.length("home")).alias("nearest"), F.bool_or(F.col("home") == "").alias("root"))
    kept = kept.select("path", F.explode(F.array_distinct(F.array_compact(F.array("nearest", F.when(F.col("root"), F.lit("")))))).alias("home"))
    pairs = kept.join(homes, "home").where("container <> path")
    depth = F.when(F.col("home") == "", 0).otherwise(F.size(F.split("home", "/")))
    return pairs.select(F.lit("orphan").alias("kind"), F.col("path").alias("doc"), F.lit("adopt").alias("offer"), F.lit("judgment").alias("warrant"), F.col("container").alias("detail"), (-depth).cast("int").alias("rank"))


def suggest(offers: DataFrame) -> DataFrame:
    """The first offer of each finding that destroys nothing."""
    safe = offers.where("warrant <> 'destructive'")
    return safe.groupBy("kind", "doc").agg(F.min(F.struct("rank", "offer", "warrant", "detail")).alias("best")).select("kind", "doc", "best.offer", "best.warrant", "best.detail")
