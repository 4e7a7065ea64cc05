"""Path and link-target algebra as Column functions, and the same over Python strings for parsers."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Drops ``.``, folds ``x/..`` and keeps leading ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(folded, "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The path without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def sidecars(path: Column, formats: tuple[str, ...] = ("yaml", "yml", "json", "toml")) -> Column:
    """The names that a payload's sidecar may have."""
    return F.array(*(F.concat(path, F.lit(f".{x}")) for x in formats))


def covering_nodes(path: Column, formats: tuple[str, ...] = ("yaml", "yml", "json", "toml")) -> Column:
    """The manifest nodes that may cover a file: beside each folder above it, ``<folder>.<extension>``."""
    return F.flatten(F.transform(ancestors(folder(path)), lambda d: sidecars(d, formats)))


def split_locator(target: Column) -> tuple[Column, Column]:
    """(target, locator): cut at the first ``#`` that is not at the start."""
    return F.regexp_replace(target, "(?s)^([^#]+)#.*$", "$1"), F.nullif(F.regexp_extract(target, "(?s)^[^#]+#(.*)$", 1), F.lit(""))


def resolve(source: Column, target: Column) -> Column:
    """The workspace path of a path target in a document: a leading ``/`` is the workspace root."""
    bare, _ = split_locator(target)
    return normalize(F.when(bare.startswith("/"), bare).otherwise(F.concat(folder(source), F.lit("/"), bare)))


def escapes(path: Column) -> Column:
    n = normalize(path)
    return path.startswith("/") | (n == "..") | n.startswith("../")


def is_external(target: Column) -> Column:
    return target.contains("://") | target.startswith("mailto:")


def is_alias(target: Column) -> Column:
    """A bare name: no separator and no extension."""
    return (target != "") & ~target.rlike(r"[/\\]") & ~target.rlike(r"(?s)^.+\.[^.]*$")


#: Schemes that mark a target as an id; older ones of a corpus may be added.
ID_SCHEMES = ("id",)


def is_id(target: Column, schemes: tuple[str, ...] = ID_SCHEMES) -> Column:
    return target.rlike(f"^({'|'.join(schemes)}):")


def id_body(target: Column, schemes: tuple[str, ...] = ID_SCHEMES) -> Column:
    return F.regexp_replace(target, f"^({'|'.join(schemes)}):", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ancestors(path: Column) -> Column:
    """The path's own prefixes, itself last: ``a/b/c`` -> ``[a, a/b, a/b/c]``. Prefix joins become equi-joins on them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def relative(source: str, target: str) -> str:
    """A path from a document to another; the same folder is ``.``."""
    return posixpath.relpath(target or ".", posixpath.dirname(source) or ".")
