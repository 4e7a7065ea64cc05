"""Mutations as plans: the affected rows of a census, and the next snapshot of the documents. Nothing is written in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder

CHANGE = ("op", "path", "site", "old", "new")


def _rows(df: DataFrame, op: str, path, site, old, new) -> DataFrame:
    return df.select(F.lit(op).alias("op"), path.alias("path"), site.alias("site"), old.cast("string").alias("old"), new.cast("string").alias("new"))


def rename(census: DataFrame, old: str, new: str) -> DataFrame:
    """Moves a document: its row, the links to it by path, and its own relative links. Links by id stay as they are.

    Rewritten targets are workspace paths from the root, which hold wherever a document stands."""
    none = F.lit(None).cast("string")
    spark = census.sparkSession
    move = _rows(spark.range(1), "rename", F.lit(old), none, F.lit(old), F.lit(new))
    by_path = F.col("resolution").isin("path", "case_mismatch")
    inbound = census.where(by_path & (F.coalesce("actual", "to_path") == old) & (F.col("source") != old))
    own = census.where((F.col("source") == old) & by_path & ~F.col("target_text").startswith("/"))
    target = F.when(F.col("to_path") == old, F.lit(new)).otherwise(F.col("to_path"))
    locator = F.coalesce(F.concat(F.lit("#"), "locator"), F.lit(""))
    return move.unionByName(_rows(inbound, "retarget", F.col("source"), F.col("site"), F.col("target_text"), F.concat(F.lit("/" + new), locator))).unionByName(
        _rows(own, "retarget", F.lit(new), F.col("site"), F.col("target_text"), F.concat(F.lit("/"), target, locator))
    )


def reparent(census: DataFrame, child: str, parent: str, spanning: str = "contents", inverse: str = "part_of") -> DataFrame:
    """Takes a document off its parents' lists and puts it on another's; its path stays."""
    old = census.where((F.col("site") == spanning) & (F.coalesce("actual", "to_path") == child) & (F.col("source") != parent))
    back = census.where((F.col("source") == child) & (F.col("site") == inverse))
    spark = census.sparkSession
    none = F.lit(None).cast("string")
    add = _rows(spark.range(1), "add_link", F.lit(parent), F.lit(spanning), none, F.lit("/" + child))
    up = _rows(spark.range(1), "set_link", F.lit(child), F.lit(inverse), none, F.lit("/" + parent))
    return _rows(old, "remove_link", F.col("source"), F.col("site"), F.col("target_text"), none).unionByName(_rows(back, "remove_link", F.col("source"), F.col("site"), F.col("target_text"), none)).unionByName(add).unionByName(up)


def retitle(census: DataFrame, path: str, title: str) -> DataFrame:
    """Sets a title and refreshes the labels of links to the document."""
    labelled = census.where((F.coalesce("actual", "to_path") == path) & F.col("label").isNotNull())
    none = F.lit(None).cast("string")
    return _rows(census.sparkSession.range(1), "set", F.lit(path), F.lit("title"), none, F.lit(title)).unionByName(_rows(labelled, "relabel", F.col("source"), F.col("site"), F.col("label"), F.lit(title)))


def delete(census: DataFrame, path: str, bin_folder: str | None = None) -> DataFrame:
    """Removes a document, or moves it to the bin, with its parents' links; other links to it are reported as danglers."""
    none = F.lit(None).cast("string")
    spark = census.sparkSession
    gone = _rows(spark.range(1), "remove" if bin_folder is None else "recycle", F.lit(path), none, F.lit(path), F.lit(None if bin_folder is None else f"{bin_folder}/{path}"))
    inbound = census.where((F.coalesce("actual", "to_path") == path) & (F.col("source") != path))
    return gone.unionByName(_rows(inbound.where("site = 'contents'"), "remove_link", F.col("source"), F.col("site"), F.col("target_text"), none)).unionByName(_rows(inbound.where("site <> 'contents'"), "dangler", F.col("source"), F.col("site"), F.col("target_text"), none))


def create(parent: str, path: str, title: str, spark) -> DataFrame:
    """A new document on its parent's list, linked both ways."""
    rows = [("create", path, None, None, title), ("add_link", parent, "contents", None, f"/{path}"), ("set_link", path, "part_of", None, f"/{parent}")]
    return spark.createDataFrame(rows, "op string, path string, site string, old string, new string")


def stamps(states: DataFrame, named: bool = False) -> DataFrame:
    """(path, op) of documents (path, state): drifted ones get a digest and a time, unrecorded ones a digest, and a time only if named."""
    op = F.when(F.col("state") == "drifted", "stamp_and_time").when((F.col("state") == "unrecorded") & F.lit(named), "stamp_and_time").when(F.col("state") == "unrecorded", "stamp")
    return states.select("path", op.alias("op")).where("op IS NOT NULL")


def mirror(files: DataFrame) -> DataFrame:
    """(dir, node, synthesized): for each folder of files (path), and those above, the document that stands for it: index, readme, or a new index."""
    from ..functions.paths import ancestors, file_name

    low = F.lower(file_name(F.col("path")))
    rank = F.when(low.rlike(r"^index\.(md|markdown|dj|html)$"), 0).when(low.rlike(r"^readme\.(md|markdown|dj|html)$"), 1)
    best = files.withColumn("rank", rank).where("rank IS NOT NULL").groupBy(folder(F.col("path")).alias("dir")).agg(F.min(F.struct("rank", "path")).alias("best"))
    dirs = files.select(F.explode(F.array_append(F.when(folder(F.col("path")) == "", F.array().cast("array<string>")).otherwise(ancestors(folder(F.col("path")))), F.lit(""))).alias("dir")).distinct()
    found = dirs.join(best, "dir", "left")
    new = F.when(F.col("dir") == "", "index.md").otherwise(F.concat("dir", F.lit("/index.md")))
    return found.select("dir", F.coalesce("best.path", new).alias("node"), F.col("best").isNull().alias("synthesized"))


def next_snapshot(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files (path, content) after the plan's renames, recyclings and removals; rewriting link texts is the editor's part."""
    ops = plan.where("op IN ('rename', 'recycle', 'remove')").select(F.col("old").alias("path"), "op", "new")
    out = files.join(ops, "path", "left").where("op IS NULL OR op <> 'remove'")
    return out.select(F.coalesce("new", "path").alias("path"), "content")
