"""Stores kept in whole-file documents: registry, manifests, vocabularies, recycle records. All read from ``meta_json``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder, normalize


def registry(docs: DataFrame, path: str) -> DataFrame:
    """(id, path): a null path is a tombstone. Values that are neither text nor null fail the read."""
    row = docs.where((F.col("path") == path) & (F.col("carrier") == "whole"))
    entries = row.select(F.explode(F.from_json(F.get_json_object("meta_json", "$.registry"), "map<string,string>", {"mode": "FAILFAST"})).alias("id", "path"))
    return entries.select("id", "path")


def fenced_stores(docs: DataFrame, paths: list[str]) -> DataFrame:
    """The stores among ``paths`` that lie in a fenced carrier: malformed_store."""
    return docs.where(F.col("path").isin(*paths) & (F.col("carrier") == "fenced")).select("path")


_ROWS = "array<struct<path:string,hash:string>>"


def manifests(docs: DataFrame) -> DataFrame:
    """(manifest, root, path, hash, error): a row for each file of a manifest; one that lacks a root, or has a row without a path or with one
    that climbs out, has a single row with its error."""
    raw = docs.where("meta_json IS NOT NULL").select(
        F.col("path").alias("manifest"), F.get_json_object("meta_json", "$.root").alias("root"), F.from_json(F.get_json_object("meta_json", "$.files"), _ROWS).alias("files"), F.col("present")
    )
    raw = raw.where("array_contains(present, 'root')")
    files = F.coalesce("files", F.array().cast(_ROWS))
    climbs = F.exists(files, lambda f: f["path"].isNull() | (F.substring(f["path"], 1, 1) == "/") | (f["path"] == "..") | f["path"].startswith("../") | f["path"].contains("/../"))
    error = F.when(F.coalesce("root", F.lit("")) == "", "no root").when(climbs, "bad row")
    root = normalize(F.when(F.col("root").startswith("/"), F.col("root")).otherwise(F.concat(folder(F.col("manifest")), F.lit("/"), F.col("root"))))
    made = raw.select("manifest", root.alias("root"), error.alias("error"), F.explode_outer(F.when(error.isNull(), files)).alias("f"))
    return made.select("manifest", "root", F.col("f.path").alias("path"), F.col("f.hash").alias("hash"), "error")


def covered_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path): opaque files (path, kind) below each manifest root (root), relative to it; files of a nested root belong to that one."""
    from ..functions.paths import ancestors

    spread = files.where("kind = 'opaque'").select("path", F.explode(ancestors(folder(F.col("path")))).alias("root"))
    nearest = spread.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return nearest.select("root", F.expr("substring(path, length(root) + 2)").alias("path"))


def terms(docs: DataFrame, path: str) -> DataFrame:
    """(field, term, id, means, retired) of a vocabulary; a term without details is live."""
    row = docs.where(F.col("path") == path)
    field = F.get_json_object("meta_json", "$.vocabulary.field")
    found = row.select(field.alias("field"), F.explode(F.from_json(F.get_json_object("meta_json", "$.terms"), "map<string,string>")).alias("term", "details")).where("field IS NOT NULL")
    return found.select("field", "term", F.get_json_object("details", "$.id").alias("id"), F.get_json_object("details", "$.means").alias("means"), F.coalesce(F.get_json_object("details", "$.retired") == "true", F.lit(False)).alias("retired"))


def recycle_records(docs: DataFrame, path: str) -> DataFrame:
    """(origin, bin): a row for each stored file of the bin's records."""
    kind = "array<struct<`from`:string,bin:string,body_bin:string>>"
    found = docs.where(F.col("path") == path).select(F.explode(F.from_json(F.get_json_object("meta_json", "$.deleted"), kind)).alias("r"))
    return found.select(F.col("r.from").alias("origin"), F.explode(F.array_compact(F.array("r.bin", "r.body_bin"))).alias("bin"))


def missing_bytes(records: DataFrame, files: DataFrame) -> DataFrame:
    """(origin, missing): records whose stored files are gone."""
    gone = records.join(files.select(F.col("path").alias("bin")), "bin", "left_anti")
    return gone.groupBy("origin").agg(F.sort_array(F.collect_set("bin")).alias("missing"))


def peers(links: DataFrame, known: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign links (workspace, id, ...) with ``peer``: confirmed, mismatched, unconfirmed or unknown.

    ``known`` has (workspace, location, says): what the location calls itself, null if it can't be read; ``indexes`` (workspace, id)."""
    j = links.join(known, "workspace", "left").join(indexes.select("workspace", "id", F.lit(True).alias("__has")), ["workspace", "id"], "left")
    state = F.when(F.col("location").isNull(), "unknown").when(F.col("says").isNotNull() & (F.col("says") != F.col("workspace")), "mismatched").when(F.col("__has"), "confirmed").otherwise("unconfirmed")
    return j.withColumn("peer", state).drop("__has", "says")
