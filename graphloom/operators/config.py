"""Workspace policy: defaults, layering, and a linter driven by a table of what each key may hold."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from . import conditions, exports, views

SPEC = 1

#: The accepted spellings of each axis, and the keys of each block.
SPELLINGS = {
    "content_format": ("markdown", "djot", "html"),
    "id_storage": ("registry", "frontmatter", "both"),
    "identity": ("none", "lazy", "eager"),
    "fixity": ("off", "attachments", "all"),
    "history": ("off", "manual"),
    "about": ("off", "structure"),
    "metadata.embed": ("delimited", "code_block", "html_script", "html_code", "separate"),
    "metadata.format": ("yaml", "json", "toml", "fig"),
    "references.notation": ("markdown", "wikilink", "bare"),
    "references.path_style": ("root", "relative"),
    "references.target": ("path", "id", "alias"),
    "relations.cardinality": ("one", "many"),
    "fields.type": ("str", "bool", "int", "float", "date", "datetime", "local-datetime", "time", "ref", "map", "seq"),
    "fields.values": ("open", "closed"),
}
ALSO = {"identity": {"off"}}
TOP = ("spec", "content_format", "metadata", "references", "relations", "spanning", "fields", "views", "exports", "id_storage", "updated", "workspace_id", "identity", "fixity", "recycle_bin", "history", "about")
BLOCKS = {
    "metadata": ("format", "embed"),
    "references": ("notation", "path_style", "target", "label"),
    "relations": ("notation", "path_style", "target", "label", "cardinality", "inverse", "means"),
    "fields": ("type", "values", "vocabulary", "reify"),
    "views": ("label", "icon", "group", "by", "under", "nest", "where"),
    "exports": ("label", "gate", "view"),
}
#: The policy of a workspace that says nothing.
DEFAULTS = {"content_format": "markdown", "id_storage": "both", "identity": "lazy", "fixity": "attachments", "recycle_bin": True, "history": "off", "about": "structure", "updated": "", "workspace_id": "", "spanning": "contents"}


@dataclass(frozen=True)
class Issue:
    key: str
    kind: str
    detail: str = ""


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(word: str, candidates) -> str | None:
    """The first of the nearest candidates at one or two edits."""
    found = [(d, i, c) for i, c in enumerate(candidates) if 1 <= (d := distance(word, c)) <= 2]
    return min(found)[2] if found else None


def effective(*layers: dict | None) -> dict:
    """Defaults under the layers, the later the stronger; views and exports merge by name, each replaced whole."""
    out: dict[str, Any] = dict(DEFAULTS)
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = {**out.get(k, {}), **v} if k in ("views", "exports") and isinstance(v, dict) else v
    return out


def spec_ahead(meta: dict) -> int | None:
    spec = meta.get("spec")
    return spec if isinstance(spec, int) and not isinstance(spec, bool) and spec > SPEC else None


def is_workspace_id(name: Any) -> bool:
    return isinstance(name, str) and bool(name) and not any(c in "/:" or c.isspace() for c in name)


def _unknown(key: str, block: str, name: str, keys) -> list[Issue]:
    near = nearest(key, keys)
    return [Issue(name, "unknown_key", f"{block}.{near}" if block else near)] if near else []


def _axis(rule: str, name: str, value: Any) -> list[Issue]:
    if rule not in SPELLINGS or isinstance(value, str) and (value.strip() in SPELLINGS[rule] or value.strip() in ALSO.get(rule, ())):
        return []
    return [Issue(name, "invalid_value", ", ".join(SPELLINGS[rule]))]


def _truth(name: str, value: Any) -> list[Issue]:
    return [] if isinstance(value, bool) else [Issue(name, "invalid_value", "true, false")]


def _block(block: str, name: str, value: Any, axes: str | None = None) -> list[Issue]:
    if not isinstance(value, dict):
        return [Issue(name, "invalid_value", "a mapping")]
    out = []
    for key, v in value.items():
        if key not in BLOCKS[block]:
            out += _unknown(key, name, f"{name}.{key}", [k for k in BLOCKS[block] if k != "means"])
        elif key in ("label", "reify") and block != "views":
            out += _truth(f"{name}.{key}", v)
        else:
            rule = f"{block}.{key}"
            out += _axis(rule if rule in SPELLINGS else f"{axes}.{key}", f"{name}.{key}", v)
    return out


def lint_view(name: str, value: Any) -> list[Issue]:
    if not isinstance(value, dict):
        return [Issue(name, "not_a_mapping")]
    out = [] if views.ViewSpec.parse(name, value) else [Issue(f"{name}.group", "no_grouping")]
    for key, v in value.items():
        if key not in BLOCKS["views"]:
            out.append(Issue(f"{name}.{key}", "unknown_key", nearest(key, BLOCKS["views"]) or ""))
        elif key in ("by", "nest") and views.Grain.parse(v) is None:
            out.append(Issue(f"{name}.{key}", "bad_grain"))
        elif key == "where" and conditions.parse(v) is None:
            out.append(Issue(f"{name}.{key}", "no_condition"))
    return out


def lint_export(name: str, value: Any, declared: set[str]) -> list[Issue]:
    if not isinstance(value, dict):
        return [Issue(name, "not_a_mapping")]
    spec = exports.ExportSpec.parse(name, value)
    out = [] if spec else [Issue(f"{name}.gate", "no_gate")]
    out += [Issue(f"{name}.{k}", "unknown_key", nearest(k, BLOCKS["exports"]) or "") for k in value if k not in BLOCKS["exports"]]
    gate = value.get("gate")
    out += [Issue(f"{name}.gate.{k}", "gate_unknown_key", nearest(k, ("field", "value")) or "") for k in (gate if isinstance(gate, dict) else ()) if k not in ("field", "value")]
    if spec and spec.view is not None and spec.view not in declared:
        out.append(Issue(f"{name}.view", "undeclared_view", nearest(spec.view, sorted(declared)) or ""))
    return out


def diagnose(meta: Any) -> list[Issue]:
    """What a config surface says that would be ignored in silence; keys that resemble nothing are the user's own."""
    if not isinstance(meta, dict):
        return []
    out: list[Issue] = []
    fields = meta.get("fields") if isinstance(meta.get("fields"), dict) else {}
    for key, value in meta.items():
        if key in ("spec", "updated"):
            continue
        if key not in TOP:
            out += _unknown(key, "", key, TOP)
        elif key == "recycle_bin":
            out += _truth(key, value)
        elif key == "workspace_id":
            out += [] if value == "" or is_workspace_id(value) else [Issue(key, "malformed_workspace_id", str(value))]
        elif key == "spanning":
            out += [] if isinstance(value, str) else [Issue(key, "invalid_value", "a relation name")]
        elif key in ("metadata", "references"):
            out += _block(key, key, value)
        elif key in ("relations", "fields", "views", "exports"):
            if not isinstance(value, dict):
                out.append(Issue(key, "invalid_value", "a mapping"))
                continue
            for name, entry in value.items():
                if key == "views":
                    out += [Issue(f"views.{i.key}", i.kind, i.detail) for i in lint_view(name, entry)]
                    spec = views.ViewSpec.parse(name, entry)
                    for f in spec.grouping.fields if spec and spec.nest else ():
                        if isinstance(fields.get(f), dict) and fields[f].get("type") == "seq":
                            out.append(Issue(f"views.{name}.nest", "nest_not_single_valued", f))
                elif key == "exports":
                    known = set(meta["views"]) if isinstance(meta.get("views"), dict) else set()
                    out += [Issue(f"exports.{i.key}", i.kind, i.detail) for i in lint_export(name, entry, known)]
                else:
                    out += _block(key, f"{key}.{name}", entry, "references")
        else:
            out += _axis(key, key, value)
    relations = meta.get("relations") if isinstance(meta.get("relations"), dict) else {}
    spine = relations.get(meta.get("spanning")) if isinstance(meta.get("spanning"), str) else None
    inverse = spine.get("inverse") if isinstance(spine, dict) else None
    if isinstance(inverse, str) and isinstance(relations.get(inverse), dict) and relations[inverse].get("cardinality") == "many":
        out.append(Issue("spanning", "spanning_not_single_parent", inverse))
    return out
