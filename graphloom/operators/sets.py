"""Differences of snapshots: findings before and after, manifests against listings, folds over folders, prefix joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def check_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows with ``change``: fixed, introduced or pre_existing. Bags: a row that stands twice on its side stays twice."""
    keys = before.columns
    after = after.select(*keys)

    def match(left: DataFrame, right: DataFrame, how: str, change: str) -> DataFrame:
        other = right.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
        return left.join(other, same, how).withColumn("change", F.lit(change))

    return match(before, after, "left_anti", "fixed").unionByName(match(after, before, "left_anti", "introduced")).unionByName(match(after, before, "left_semi", "pre_existing"))


def manifest_diff(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of rows (path, hash): missing, extra, changed or same. A null hash is unrecorded and never changed."""
    a, b = listed.select("path", F.col("hash").alias("was"), F.lit(True).alias("l")), found.select("path", F.col("hash").alias("is"), F.lit(True).alias("f"))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("was").isNotNull() & (F.col("was") != F.col("is")), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def manifest_status(diff: DataFrame, listed: DataFrame) -> DataFrame:
    """(listed, missing, extra, hashed): counts, and whether all rows have a hash (true if there are none)."""
    both = diff.select("status", F.lit(None).cast("boolean").alias("has")).unionByName(listed.select(F.lit(None).cast("string").alias("status"), F.col("hash").isNotNull().alias("has")))
    count = lambda c, name: F.count_if(c).alias(name)
    status = F.col("status")
    return both.agg(count(status != "extra", "listed"), count(status == "missing", "missing"), count(status == "extra", "extra"), F.coalesce(F.every("has"), F.lit(True)).alias("hashed"))


def under_prefixes(rows: DataFrame, prefixes: DataFrame, column: str = "path") -> DataFrame:
    """The rows whose path is one of the prefixes (prefix) or lies below one, once each, by an equi-join on ancestors."""
    spread = rows.withColumn("__prefix", F.explode(ancestors(F.col(column))))
    return spread.join(prefixes.select(F.col("prefix").alias("__prefix")).distinct(), "__prefix", "left_semi").drop("__prefix").dropDuplicates([column])


def skip_rules(files: DataFrame) -> DataFrame:
    """(path, kind): rules that cover all skipped files (path, reached, tracked).

    A folder collapses into one ``under`` rule if it has files, none is reached and none tracked; other unreached files have a ``file`` rule, except tracked ones, which
    are withheld. Every folder's facts are one aggregate over the ancestors of its files; the topmost collapsed folder wins.
    """
    parts = F.split("path", "/")
    spread = files.withColumn("__up", F.slice(ancestors(F.col("path")), 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    folders = spread.select(F.explode("__up").alias("folder"), "reached", "tracked").groupBy("folder").agg(F.bool_or("reached").alias("reached"), F.bool_or("tracked").alias("tracked"))
    closed = folders.where("NOT reached AND NOT tracked").select("folder")
    tops = closed.withColumn("__above", F.slice(ancestors(F.col("folder")), 1, F.greatest(F.size(F.split("folder", "/")) - 1, F.lit(0))))
    covered = tops.select("folder", F.explode("__above").alias("above")).join(closed.select(F.col("folder").alias("above")), "above", "left_semi").select("folder").distinct()
    tops = closed.join(covered, "folder", "left_anti")
    loose = under_prefixes(files, tops.select(F.col("folder").alias("prefix"))).select("path")
    single = files.where("NOT reached AND NOT tracked").select("path").join(loose, "path", "left_anti")
    return tops.select(F.col("folder").alias("path"), F.lit("under").alias("kind")).unionByName(single.withColumn("kind", F.lit("file")))


def withheld(files: DataFrame) -> DataFrame:
    """Tracked files that nothing reaches: they are neither kept nor skipped."""
    return files.where("tracked AND NOT reached").select("path")


def rule_changes(rules: DataFrame, standing: DataFrame) -> DataFrame:
    """(path, kind, change): rules that the standing ones lack are fresh, standing ones that no rule asks for stale."""
    key = ["path", "kind"]
    return rules.join(standing, key, "left_anti").withColumn("change", F.lit("fresh")).unionByName(standing.join(rules, key, "left_anti").withColumn("change", F.lit("stale")))
