"""Declarative views: fallback chains of grouping fields, grains, selection, multi-valued groups and nest routes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import path_order, texts, trimmed
from . import conditions

_DATES = {"year": r"^([0-9]{4})(?![0-9])", "month": r"^([0-9]{4}-[0-9]{2})", "day": r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"}


@dataclass(frozen=True)
class Grain:
    """A cut of a value: year, month or day of an ISO date prefix, or its first ``n`` characters in upper case."""

    kind: str
    n: int = 0

    @staticmethod
    def parse(value: Any) -> Grain | None:
        """A bare word, or a mapping with the one key ``initial`` and a positive number."""
        if isinstance(value, str) and value.strip() in _DATES:
            return Grain(value.strip())
        if isinstance(value, dict) and list(value) == ["initial"]:
            n = value["initial"]
            n = int(n) if isinstance(n, str) and n.strip().isdecimal() else n
            return Grain("initial", n) if isinstance(n, int) and not isinstance(n, bool) and n > 0 else None
        return None

    @property
    def display(self) -> str:
        return f"initial {self.n}" if self.kind == "initial" and self.n > 1 else self.kind

    def to_value(self) -> Any:
        return {"initial": self.n} if self.kind == "initial" else self.kind

    def cut(self, value: Column) -> Column:
        """The key of a value, null if the grain rejects it."""
        if self.kind == "initial":
            return F.nullif(F.upper(F.substring(trimmed(value), 1, self.n)), F.lit(""))
        return F.nullif(F.regexp_extract(trimmed(value), _DATES[self.kind], 1), F.lit(""))

    def chain(self) -> list[Grain]:
        """The grain and the coarser ones, coarsest first."""
        if self.kind == "initial":
            return [self]
        return [Grain(k) for k in list(_DATES)[: list(_DATES).index(self.kind) + 1]]


@dataclass(frozen=True)
class Grouping:
    fields: tuple[str, ...]
    by: Grain | None = None

    def raw(self) -> Column:
        """The texts of the first field that has any; a text that the grain rejects doesn't fall through."""
        out = F.array().cast("array<string>")
        for f in reversed(self.fields):
            out = F.when(F.size(texts(f)) > 0, texts(f)).otherwise(out)
        return out

    def keys(self) -> Column:
        keys = self.raw()
        if self.by is not None:
            keys = F.filter(F.transform(keys, self.by.cut), lambda k: k.isNotNull())
        return F.array_distinct(keys)


@dataclass(frozen=True)
class ViewSpec:
    name: str
    grouping: Grouping
    under: str | None = None
    where: Any = None
    nest: Grain | None = None
    label: str | None = None
    icon: str | None = None

    @staticmethod
    def parse(name: str, value: Any) -> ViewSpec | None:
        """None without a usable ``group``."""
        if not isinstance(value, dict):
            return None
        fields = conditions.literal_texts(value.get("group"))
        if not fields:
            return None
        one = lambda k: next(iter(conditions.literal_texts(value.get(k))), None)
        return ViewSpec(name, Grouping(tuple(fields), Grain.parse(value.get("by"))), one("under"), conditions.parse(value.get("where")), Grain.parse(value.get("nest")), one("label"), one("icon"))

    def to_mapping(self) -> dict:
        out: dict[str, Any] = {"label": self.label, "icon": self.icon}
        out["group"] = self.grouping.fields[0] if len(self.grouping.fields) == 1 else list(self.grouping.fields)
        out |= {"by": self.grouping.by and self.grouping.by.to_value(), "under": self.under, "nest": self.nest and self.nest.to_value(), "where": self.where and self.where.to_value()}
        return {k: v for k, v in out.items() if v is not None}

    @property
    def display_label(self) -> str:
        if self.label:
            return self.label
        s = self.name.replace("_", " ").replace("-", " ").lower()
        return s[:1].upper() + s[1:]


def views_from(mapping: Any) -> dict[str, ViewSpec]:
    return {n: v for n, x in (mapping if isinstance(mapping, dict) else {}).items() if (v := ViewSpec.parse(n, x)) is not None}


def select(docs: DataFrame, where: Any = None, scope: DataFrame | None = None) -> DataFrame:
    """The documents (path, texts, ...) of a scope (path) that meet a condition, once each."""
    if scope is not None:
        docs = docs.join(scope.select("path"), "path", "left_semi")
    return docs if where is None else docs.where(where.column())


def placements(rows: DataFrame, grouping: Grouping) -> DataFrame:
    """(key, path): a row for each group that a document is in, key null for the ungrouped."""
    return rows.select("path", F.explode_outer(grouping.keys()).alias("key")).select("key", "path").distinct()


def group(rows: DataFrame, grouping: Grouping) -> DataFrame:
    """(key, n_documents, paths): groups by key, paths by component order; key null holds the ungrouped.

    Collects a group's paths into one row. At scale use ``counts`` or keep ``placements``, which are flat.
    """
    placed = placements(rows, grouping).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(path_order(F.col("path")).alias("order"), "path"))).alias("members"))
    return placed.select("key", F.size("members").cast("long").alias("n_documents"), F.col("members.path").alias("paths")).orderBy("key")


def counts(rows: DataFrame, grouping: Grouping) -> DataFrame:
    """(key, n_documents) of each group, key null for the ungrouped; partial sums before the shuffle."""
    return rows.select("path", F.explode_outer(grouping.keys()).alias("key")).groupBy("key").agg(F.count_distinct("path").alias("n_documents"))


def totals(rows: DataFrame, grouping: Grouping) -> DataFrame:
    """(n_documents, n_placements): documents, and rows of all groups with the ungrouped ones."""
    return placements(rows, grouping).agg(F.count_distinct("path").alias("n_documents"), F.count(F.lit(1)).alias("n_placements"))


def nest_route(docs: DataFrame, grouping: Grouping, nest: Grain) -> DataFrame:
    """The documents with ``route``: one title for each grain of the chain; null unless there is exactly one text and all grains accept it.

    The text and the titles are columns of their own, so that each is computed once a row."""
    raw = docs.withColumn("__raw", grouping.raw())
    one = raw.withColumn("__one", F.when(F.size("__raw") == 1, F.try_element_at("__raw", F.lit(1))))
    titles = one.withColumn("__titles", F.array_compact(F.array(*(g.cut(F.col("__one")) for g in nest.chain()))))
    return titles.withColumn("route", F.when(F.size("__titles") == len(nest.chain()), F.col("__titles"))).drop("__raw", "__one", "__titles")
