"""Traversal of a spanning relation by frontiers: trees by paths, walks by visited sets, roots by pointer jumping.

``edges`` has (source, target, ord). A round joins the frontier with the edges and stores its result in the shared folder, so that lineage stays short
and a lost executor costs one round. Rounds follow the depth of the graph, never its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import stored

MOST_DEPTH = 10_000


def tree(edges: DataFrame, starts: DataFrame, docs: DataFrame | None = None, ignore_missing: bool = False) -> DataFrame:
    """(path, parent, depth, trail, ordinal, kind): every occurrence of a node below the starts (path).

    Cycles are found on the path to the root: a node that is its own ancestor is a ``cycle`` leaf, while a diamond is expanded twice. Targets
    that are not in ``docs`` (path) are ``missing`` leaves. The order of ``ordinal`` is depth first in declaration order.
    """
    level = starts.select("path", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("path").alias("trail"), F.array(F.lit(0)).alias("ordinal"), F.lit("doc").alias("kind"))
    level = stored(level, "tree")
    levels = [level]
    step = edges.select("source", "target", F.col("ord").cast("int").alias("ord"))
    for depth in range(1, MOST_DEPTH):
        live = level.where("kind = 'doc'").select(F.col("path").alias("source"), "trail", "ordinal")
        found = live.join(step, "source").select(
            F.col("target").alias("path"), F.col("source").alias("parent"), F.lit(depth).alias("depth"), "trail", F.array_append("ordinal", F.col("ord")).alias("ordinal")
        )
        kind = F.when(F.array_contains("trail", F.col("path")), "cycle")
        if docs is not None:
            found = found.join(docs.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
            kind = kind.when(F.col("there").isNull(), "missing")
        found = found.select("path", "parent", "depth", F.array_append("trail", F.col("path")).alias("trail"), "ordinal", kind.otherwise("doc").alias("kind"))
        if ignore_missing:
            found = found.where("kind <> 'missing'")
        level = stored(found, "tree")
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise RuntimeError(f"the tree is deeper than {MOST_DEPTH} levels")
    return reduce(DataFrame.unionByName, levels)


def walk(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, depth): the nodes that the starts reach, each once at its least depth."""
    level = stored(starts.select("path").distinct().withColumn("depth", F.lit(0)), "walk")
    seen = level
    step = edges.select("source", F.col("target").alias("path"))
    for depth in range(1, MOST_DEPTH):
        found = level.select(F.col("path").alias("source")).join(step, "source").select("path").distinct().join(seen.select("path"), "path", "left_anti")
        level = stored(found.withColumn("depth", F.lit(depth)), "walk")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    else:
        raise RuntimeError(f"the walk is longer than {MOST_DEPTH} steps")
    return seen


def reachable(spanning: DataFrame, overlay: DataFrame, starts: DataFrame) -> DataFrame:
    """(path): what the walk visits, and the targets of the visited documents' other links, which are reached but not descended."""
    visited = walk(spanning, starts).select("path")
    others = visited.select(F.col("path").alias("source")).join(overlay.select("source", F.col("target").alias("path")), "source").select("path")
    return visited.unionByName(others).distinct()


def spanning_root(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(path, root) from (path, parent) by pointer jumping: rounds grow with the logarithm of the depth. Nodes of a cycle have no root."""
    links = parents.select("path", "parent").where("parent IS NOT NULL")
    nodes = links.select("path").unionByName(links.select(F.col("parent").alias("path"))).distinct()
    at = stored(nodes.join(links, "path", "left").select("path", F.coalesce("parent", "path").alias("up"), F.col("parent").isNull().alias("done")), "roots")
    for _ in range(most_rounds):
        if at.where("NOT done").isEmpty():
            break
        above = at.select(F.col("path").alias("up"), F.col("up").alias("next"), F.col("done").alias("above_done"))
        step = at.join(above, "up").select("path", F.when(F.col("done"), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("done") | F.col("above_done")).alias("done"))
        at = stored(step, "roots")
    return at.select("path", F.when(F.col("done"), F.col("up")).alias("root"))


def islands(claims: DataFrame, reached: DataFrame) -> DataFrame:
    """(path): unreached documents whose chain of claimed parents (path, parent) leads into the reached set."""
    open_claims = claims.join(reached.select("path"), "path", "left_anti")
    return walk(open_claims.select(F.col("parent").alias("source"), F.col("path").alias("target")), reached).where("depth > 0").select("path")


def route(children: DataFrame, start: str, segments: list[str]) -> DataFrame:
    """(segment, path, n): for each segment the child of that title; n > 1 is ambiguous, a missing row ends the known route.

    ``children`` has (source, path, title). One join for each segment; titles match exactly.
    """
    spark = children.sparkSession
    here = spark.createDataFrame([(start,)], "path string")
    found = []
    for i, title in enumerate(segments):
        step = children.where(F.col("title") == title).join(here.select(F.col("path").alias("source")), "source")
        here = step.groupBy(F.lit(i).alias("segment")).agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))
        found.append(here)
        here = here.where("n = 1")
    return reduce(DataFrame.unionByName, found) if found else here.select(F.lit(0).alias("segment"), "path", F.lit(1).cast("long").alias("n")).limit(0)


def planned_route(found: list[tuple[str, int]], segments: list[str], start: str) -> tuple[list[str], list[str]]:
    """(paths of the known documents, titles to create after them) from the rows (path, n) of ``route``; more than one match is an error."""
    known = [start]
    for path, n in found[: len(segments)]:
        if n > 1:
            raise ValueError(f"{n} documents below {known[-1]} have the title {segments[len(known) - 1]}")
        known.append(path)
    return known, segments[len(known) - 1 :]


def route_segments(text: str) -> list[str]:
    return [s.strip() for s in text.split("/") if s.strip()]
