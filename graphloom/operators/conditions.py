"""The closed set of conditions of a view: has, equals, not, all-of and any-of, compiled to two-valued Columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import all_of, any_of, texts


def literal_texts(value: Any) -> list[str]:
    """Trimmed non-empty texts of a scalar, or of a list's scalars."""
    if isinstance(value, list):
        return [t for v in value if not isinstance(v, (list, dict)) for t in literal_texts(v)]
    if value is None or isinstance(value, dict):
        return []
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    text = str(value).strip()
    return [text] if text else []


@dataclass(frozen=True)
class Has:
    field: str

    def column(self) -> Column:
        return F.size(texts(self.field)) > 0

    def to_value(self) -> dict:
        return {"has": self.field}


@dataclass(frozen=True)
class Equals:
    field: str
    value: str

    def column(self) -> Column:
        return F.array_contains(texts(self.field), self.value)

    def to_value(self) -> dict:
        return {"equals": {self.field: self.value}}


@dataclass(frozen=True)
class Not:
    part: Any

    def column(self) -> Column:
        return ~self.part.column()

    def to_value(self) -> dict:
        return {"not": self.part.to_value()}


@dataclass(frozen=True)
class AllOf:
    parts: tuple

    def column(self) -> Column:
        return all_of([p.column() for p in self.parts])

    def to_value(self) -> dict:
        return {"all-of": [p.to_value() for p in self.parts]}


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def column(self) -> Column:
        return any_of([p.column() for p in self.parts])

    def to_value(self) -> dict:
        return {"any-of": [p.to_value() for p in self.parts]}


def _list(value: Any) -> list:
    return value if isinstance(value, list) else [value]


def parse(value: Any) -> Has | Equals | Not | AllOf | AnyOf | None:
    """A condition from its mapping; several keys, fields or values mean all of them. Unknown keys are dropped; nothing usable is None."""
    if not isinstance(value, dict):
        return None
    parts: list = []
    for key, v in value.items():
        if key == "has":
            parts += [Has(t) for x in _list(v) for t in literal_texts(x)]
        elif key == "equals" and isinstance(v, dict):
            parts += [Equals(str(f), found[0]) for f, x in v.items() if (found := literal_texts(x))]
        elif key == "not" and (part := parse(v)) is not None:
            parts.append(Not(part))
        elif key in ("all-of", "any-of"):
            children = tuple(c for x in _list(v) if (c := parse(x)) is not None)
            if children:
                parts.append((AllOf if key == "all-of" else AnyOf)(children))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else AllOf(tuple(parts))
