"""Exports: a gate lets documents out, a view can only narrow what it lets out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import texts
from .conditions import literal_texts


@dataclass(frozen=True)
class Gate:
    field: str
    value: str

    def declared(self) -> Column:
        """The field's texts: null if it is absent, empty if it is there without any."""
        return F.when(F.array_contains("present", self.field), texts(self.field))

    def admits(self) -> Column:
        return F.coalesce(F.array_contains(self.declared(), self.value.strip()), F.lit(False))


@dataclass(frozen=True)
class ExportSpec:
    name: str
    gate: Gate
    view: str | None = None

    @staticmethod
    def parse(name: str, value: Any) -> ExportSpec | None:
        """None without a complete gate: an export fails closed."""
        gate = value.get("gate") if isinstance(value, dict) else None
        if not isinstance(gate, dict):
            return None
        field, wanted = literal_texts(gate.get("field")), literal_texts(gate.get("value"))
        if not field or not wanted:
            return None
        view = literal_texts(value.get("view"))
        return ExportSpec(name, Gate(field[0], wanted[0]), view[0] if view else None)

    def to_mapping(self) -> dict:
        return {"gate": {"field": self.gate.field, "value": self.gate.value}} | ({"view": self.view} if self.view else {})


def exports_from(mapping: Any) -> dict[str, ExportSpec]:
    return {n: e for n, x in (mapping if isinstance(mapping, dict) else {}).items() if (e := ExportSpec.parse(n, x)) is not None}


def plan(docs: DataFrame, spec: ExportSpec, in_view: Column | None = None) -> DataFrame:
    """The documents with ``disposition``: entry, outside_view or withheld, and ``declared``, the gate field's texts."""
    inside = F.lit(True) if in_view is None else F.coalesce(in_view, F.lit(False))
    disposition = F.when(~spec.gate.admits(), "withheld").when(inside, "entry").otherwise("outside_view")
    return docs.withColumns({"disposition": disposition, "declared": spec.gate.declared()})
