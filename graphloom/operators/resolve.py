"""Resolution of links against paths, ids and titles, and its inversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.values import trimmed


def title_index(docs: DataFrame) -> DataFrame:
    """(name, paths): the documents of each title and of each file stem; blank names are ignored."""
    stem = F.regexp_replace(paths.file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    names = docs.select(F.explode(F.array(trimmed(F.col("title")), stem)).alias("name"), "path").where("name <> ''")
    return names.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def resolve(edges: DataFrame, files: DataFrame, registry: DataFrame | None = None, titles: DataFrame | None = None, workspace_id: str | None = None, valid_id=None, id_schemes: tuple[str, ...] = paths.ID_SCHEMES) -> DataFrame:
    """``edges`` (source, target_text, ...) with resolution, to_path, actual, id, tombstoned and candidates.

    resolution is one of path, case_mismatch, broken, id, dangling_id, malformed_id, ambiguous_alias, external and foreign. ``files`` has (path);
    ``registry`` (id, path), a null path being a tombstone; ``titles`` (name, paths). ``valid_id`` maps an id Column to a boolean one. Every lookup is an equi-join;
    only if no name is equal does a name that differs in ASCII case count, of several the greatest. Links that a lookup doesn't concern join it by a key of their own that matches
    nothing, so that they are spread over all tasks.
    """
    spark = edges.sparkSession
    registry = spark.createDataFrame([], "id string, path string") if registry is None else registry
    titles = spark.createDataFrame([], "name string, paths array<string>") if titles is None else titles
    bare, locator = paths.split_locator(F.col("target_text"))
    e = edges.withColumns({"__bare": bare, "locator": locator})
    body = paths.id_body(F.col("__bare"), id_schemes)
    foreign = body.contains("/") & (F.lit(True) if workspace_id is None else F.split(body, "/")[0] != workspace_id)
    own = F.when(body.contains("/") & ~foreign, F.split(body, "/")[1]).otherwise(body)
    kind = (
        F.when(paths.is_external(F.col("target_text")), "external")
        .when(paths.is_id(F.col("__bare"), id_schemes) & foreign, "foreign")
        .when(paths.is_id(F.col("__bare"), id_schemes), "id")
        .when(paths.is_alias(F.col("__bare")), "alias")
        .otherwise("path")
    )
    e = e.withColumns({"__kind": kind, "__id": F.when(paths.is_id(F.col("__bare"), id_schemes), own), "__path": paths.resolve(F.col("source"), F.col("__bare"))})
    nothing = F.concat(F.lit("\u0000"), F.xxhash64("source", "target_text").cast("string"))
    by_name = F.col("__kind").isin("path", "alias")
    e = e.withColumns({"__id_key": F.coalesce("__id", nothing), "__name_key": F.when(F.col("__kind") == "alias", F.col("__bare")).otherwise(nothing), "__path": F.when(by_name, F.col("__path")).otherwise(nothing)})
    there = files.select(F.col("path").alias("__path"), F.lit(True).alias("__exact")).distinct()
    folded = files.groupBy(paths.ascii_lower(F.col("path")).alias("__low")).agg(F.max("path").alias("__actual"))
    e = e.join(there, "__path", "left").withColumn("__low", paths.ascii_lower(F.col("__path"))).join(folded, "__low", "left")
    e = e.join(registry.select(F.col("id").alias("__id_key"), F.col("path").alias("__live"), F.lit(True).alias("__known")), "__id_key", "left")
    e = e.join(titles.select(F.col("name").alias("__name_key"), F.col("paths").alias("__names")), "__name_key", "left")
    n = F.coalesce(F.size("__names"), F.lit(0))
    ok = F.lit(True) if valid_id is None else valid_id(F.col("__id"))
    # A bare name that no title has may still be a file without an extension.
    by_path = F.when(F.col("__exact"), "path").when(F.col("__actual").isNotNull(), "case_mismatch").otherwise("broken")
    resolution = (
        F.when(F.col("__kind").isin("external", "foreign"), F.col("__kind"))
        .when((F.col("__kind") == "id") & ~ok, "malformed_id")
        .when((F.col("__kind") == "id") & F.col("__live").isNotNull(), "id")
        .when(F.col("__kind") == "id", "dangling_id")
        .when((F.col("__kind") == "alias") & (n == 1), "path")
        .when((F.col("__kind") == "alias") & (n > 1), "ambiguous_alias")
        .otherwise(by_path)
    )
    alias_hit = (F.col("__kind") == "alias") & (n == 1)
    e = e.withColumn("resolution", resolution)
    is_ = lambda *k: F.col("resolution").isin(*k)
    return e.withColumns(
        {
            "to_path": F.when(is_("id"), F.col("__live")).when(is_("path") & alias_hit, F.try_element_at("__names", F.lit(1))).when(is_("path", "case_mismatch"), F.col("__path")),
            "actual": F.when(is_("case_mismatch"), F.col("__actual")),
            "id": F.when(is_("id", "dangling_id", "malformed_id"), F.col("__id")),
            "tombstoned": F.when(is_("dangling_id"), F.coalesce("__known", F.lit(False))),
            "candidates": F.when(is_("ambiguous_alias"), F.col("__names")),
            "workspace": F.when(is_("foreign"), F.split(body, "/")[0]),
        }
    ).drop(*(c for c in e.columns if c.startswith("__")))


def backlinks(census: DataFrame, target: Column | None = None) -> DataFrame:
    """(to_path, source, site, by_id): the census turned round, a row for each link that has a target."""
    found = census.where("to_path IS NOT NULL")
    if target is not None:
        found = found.where(F.col("to_path") == target)
    return found.select("to_path", "source", "site", (F.col("resolution") == "id").alias("by_id"))


def inbound(census: DataFrame) -> DataFrame:
    """(to_path, n_links, n_sources) with partial counts before the shuffle."""
    return backlinks(census).groupBy("to_path").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("source").alias("n_sources"))
