"""Column functions over the texts of metadata values; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed(c: Column) -> Column:
    """Without white space, of Unicode too, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def scalar_text(c: Column, kind: T.DataType) -> Column:
    """The text of a scalar: whole floats have no fraction, time is ISO 8601, an empty text is null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when((c == F.floor(c)) & (F.abs(c) < 1e18), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    elif isinstance(kind, T.TimestampType):
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(kind, T.BooleanType):
        c = F.when(c, "true").when(~c, "false")
    return F.nullif(trimmed(c.cast("string")), F.lit(""))


def texts_map(fields: dict[str, Column]) -> Column:
    """MAP<field, ARRAY<text>> of already rendered texts or arrays of them; nulls go, and fields without a text have an empty array."""
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.array_compact(v) for v in fields.values())))


def texts(field: str, column: str = "texts") -> Column:
    return F.coalesce(F.col(column)[field], F.array().cast("array<string>"))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def path_order(c: Column) -> Column:
    """Sorts paths by component: ``a/b`` before ``a.b``."""
    return F.split(c, "/")


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def is_recognized(c: Column) -> Column:
    return F.coalesce(c.startswith("sha256:"), F.lit(False))


def verifies(recorded: Column, content: Column) -> Column:
    """True too for an empty digest and for one of an unknown algorithm."""
    return F.when(is_recognized(recorded), recorded == digest(content)).otherwise(True)


def humanize(c: Column) -> Column:
    """``due_date`` -> ``Due date``."""
    s = F.lower(F.regexp_replace(c, "[_-]", " "))
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def path_to_title(path: Column) -> Column:
    """The stem's words, each with an upper-case first letter (ASCII) and the rest as it is."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    words = F.filter(F.split(stem, "[_ -]"), lambda w: w != "")
    return F.concat_ws(" ", F.transform(words, lambda w: F.concat(F.translate(F.substring(w, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), w.substr(F.lit(2), F.length(w)))))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{Alnum}]+", "-"), "^-|-$", "")
    return F.when(s == "", "untitled").otherwise(s)


def near(a: Column, b: Column, most: int = 2) -> Column:
    """The edit distance if it is from 1 to ``most``, else null."""
    d = F.levenshtein(a, b, most)
    return F.when((d >= 1) & (d <= most), d)
