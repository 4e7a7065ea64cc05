"""Integrity findings as rows (kind, subject, doc, detail); each check is a join or a predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import digest, is_recognized, near, path_order


def finding(df: DataFrame, kind: str, subject: Column, doc: Column, detail: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), doc.cast("string").alias("doc"), text.alias("detail"))


_LINK_KINDS = {"broken": "broken_link", "case_mismatch": "case_mismatch", "malformed_id": "malformed_id", "dangling_id": "dangling_id", "ambiguous_alias": "ambiguous_alias"}


def link_findings(census: DataFrame) -> DataFrame:
    """Broken, case-mismatched, malformed, dangling and ambiguous links; external and foreign ones are never findings."""
    kind = F.create_map(*(F.lit(x) for pair in _LINK_KINDS.items() for x in pair))[F.col("resolution")]
    bad = census.where(F.col("resolution").isin(*_LINK_KINDS))
    return bad.select(kind.alias("kind"), F.col("source").alias("subject"), F.col("source").alias("doc"), F.col("target_text").alias("detail"))


def duplicate_containment(spanning: DataFrame) -> DataFrame:
    """(source, target): spanning edges but the first one to each target, in the order of depth, source and ordinal."""
    place = F.struct("depth", path_order(F.col("source").cast("string")).alias("at"), "ord")
    first = spanning.groupBy("target").agg(F.min(place).alias("__first"))  # a partial minimum: a target's edges need not meet in one task
    return spanning.join(first, "target").where(place != F.col("__first")).select(*spanning.columns)


def missing_inverse(spanning: DataFrame, inverse: DataFrame) -> DataFrame:
    """Spanning edges (source, target) whose target doesn't point back (source, target)."""
    back = inverse.select(F.col("source").alias("target"), F.col("target").alias("source"))
    return spanning.join(back, ["source", "target"], "left_anti")


def orphans(files: DataFrame, reached: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Files (path, dir) in folders of reached documents (path, dir) that nothing reaches."""
    out = files.join(reached.select("dir").distinct(), "dir", "left_semi").join(reached.select("path"), "path", "left_anti")
    return out if exempt is None else out.join(exempt.select("path"), "path", "left_anti")


def unknown_terms(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(path, field, value, retired): values of closed fields without a live term. ``terms`` has (field, term, retired)."""
    known = terms.select("field", F.col("term").alias("value"), F.coalesce("retired", F.lit(False)).alias("retired"))
    return values.join(known, ["field", "value"], "left").where("retired IS NULL OR retired").select("path", "field", "value", F.coalesce("retired", F.lit(False)).alias("retired"))


def near_miss_terms(values: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(path, field, value, term, distance): values of open fields that are not terms but within ``most`` edits of a live one: the nearest, of equals the first.

    Distinct values, not rows, meet the terms of their field with lengths that differ by no more than ``most``.
    """
    live = terms.where(~F.coalesce("retired", F.lit(False))).select("field", "term")
    distinct = values.select("field", "value").distinct().join(terms.select("field", F.col("term").alias("value")), ["field", "value"], "left_anti")
    spread = distinct.withColumn("size", F.explode(F.sequence(F.length("value") - most, F.length("value") + most)))
    pairs = spread.join(live.withColumn("size", F.length("term")), ["field", "size"]).withColumn("distance", near(F.col("value"), F.col("term"), most)).where("distance IS NOT NULL")
    best = pairs.groupBy("field", "value").agg(F.min(F.struct("distance", "term")).alias("best")).select("field", "value", "best.term", "best.distance")
    return values.join(best, ["field", "value"]).select("path", "field", "value", "term", "distance")


def id_findings(docs: DataFrame, registry: DataFrame, stamping: bool = True) -> DataFrame:
    """id_mismatch, unregistered_id and unstamped_id from documents (path, fm_id) and a registry (id, path)."""
    by_id = registry.select(F.col("id").alias("fm_id"), F.col("path").alias("at"), F.lit(True).alias("known"))
    by_path = registry.where("path IS NOT NULL").select("path", F.col("id").alias("registered"))
    d = docs.select("path", "fm_id").join(by_id, "fm_id", "left").join(by_path, "path", "left")
    has = F.col("fm_id").isNotNull()
    kind = (
        F.when(has & F.col("registered").isNotNull() & (F.col("registered") != F.col("fm_id")), "id_mismatch")
        .when(has & F.col("known") & F.col("at").isNotNull() & (F.col("at") != F.col("path")), "id_mismatch")
        .when(has & F.col("known").isNull(), "unregistered_id")
        .when(~has & F.col("registered").isNotNull() & F.lit(stamping), "unstamped_id")
    )
    return d.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", F.col("path").alias("subject"), F.col("path").alias("doc"), F.coalesce("fm_id", "registered").alias("detail"))


def conflicts(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests (id, path) with ``conflict``: id_taken, path_taken or null."""
    taken = registry.where("path IS NOT NULL").select("id", F.col("path").alias("at"))
    named = registry.where("path IS NOT NULL").select("path", F.col("id").alias("other"))
    r = requests.join(taken, "id", "left").join(named, "path", "left")
    return r.select("id", "path", F.when(F.col("at") != F.col("path"), "id_taken").when(F.col("other") != F.col("id"), "path_taken").alias("conflict"))


def stale_labels(census: DataFrame, titles: DataFrame) -> DataFrame:
    """Links by id whose label is not the target's title (path, title)."""
    by_id = census.where("resolution = 'id' AND label IS NOT NULL")
    return by_id.join(titles.select(F.col("path").alias("to_path"), "title"), "to_path").where("title IS NOT NULL AND label <> title")


def fixity(docs: DataFrame) -> DataFrame:
    """Documents (path, recorded, content) with ``state``: unrecorded, unverifiable, intact or drifted."""
    recorded = F.coalesce("recorded", F.lit(""))
    state = F.when(recorded == "", "unrecorded").when(~is_recognized(recorded), "unverifiable").when(recorded == digest(F.coalesce("content", F.lit(""))), "intact").otherwise("drifted")
    return docs.withColumn("state", state)


def combine(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)
