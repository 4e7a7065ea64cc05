"""Documents from text: metadata in whole files by extension, or before the body between delimiters."""

from __future__ import annotations

import html
import json
import re
import tomllib
from functools import cache
from typing import Any

#: Extensions and fences of the formats.
WHOLE = {"yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml"}
CONTENT = frozenset(("md", "markdown", "dj", "djot", "html", "htm"))
_FENCES = {"---": "yaml", "+++": "toml", ";;;": "json"}


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def kind_of(path: str) -> str:
    ext = extension(path)
    return "content" if ext in CONTENT else "meta" if ext in WHOLE else "opaque"


@cache
def _loader():
    import yaml

    class Loader(yaml.SafeLoader):
        """Null, booleans, integers and floats only: dates and words like yes stay text."""

    Loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^[-+]?[0-9]+$", list("-+0123456789")),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", list("-+0123456789.")),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    return Loader


def _yaml(text: str) -> Any:
    import yaml

    return yaml.load(text, _loader())  # noqa: S506


def parse_value(text: str, form: str) -> Any:
    if form == "yaml":
        return _yaml(text)
    return json.loads(text) if form == "json" else tomllib.loads(text)


def split(path: str, text: str) -> tuple[str | None, str, str, str]:
    """(carrier kind, format, metadata text, body); an unterminated fence means no metadata."""
    ext = extension(path)
    if ext in WHOLE:
        return "whole", WHOLE[ext], text, ""
    mark = text[:3]
    if mark in _FENCES and (m := re.match(rf"{re.escape(mark)}[ \t]*\r?\n(.*?)^{re.escape(mark)}[ \t]*(?:\r?\n|\Z)", text, re.DOTALL | re.MULTILINE)):
        return "fenced", _FENCES[mark], m[1], text[m.end() :]
    if m := re.match(r"---(json|toml)[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", text, re.DOTALL | re.MULTILINE):
        return "fenced", m[1], m[2], text[m.end() :]
    if m := re.match(r"(```+)(yaml|json|toml)[ \t]*\r?\n(.*?)^\1[ \t]*(?:\r?\n|\Z)", text, re.DOTALL | re.MULTILINE):
        return "fenced", m[2], m[3], text[m.end() :]
    if m := re.search(r"^(```+)endmatter[ \t]*\r?\n(.*?)^\1[ \t]*\s*\Z", text, re.DOTALL | re.MULTILINE):
        return "fenced", "yaml", m[2], text[: m.start()]
    if ext in ("html", "htm"):
        head = r"\s*(?:<!doctype[^>]*>\s*)?"
        if m := re.match(head + r"<script\b[^>]*\btype=[\"']application/(yaml|json|toml)[\"'][^>]*>(.*?)</script>[ \t]*(?:\r?\n)?", text, re.DOTALL | re.IGNORECASE):
            return "fenced", m[1].lower(), m[2], text[m.end() :]
        if m := re.match(head + r"<pre>\s*<code\b[^>]*\bclass=[\"']language-(yaml|json|toml)[\"'][^>]*>(.*?)</code>\s*</pre>[ \t]*(?:\r?\n)?", text, re.DOTALL | re.IGNORECASE):
            return "fenced", m[1].lower(), html.unescape(m[2]), text[m.end() :]
    return None, "", "", text


def parse(path: str, text: str) -> dict[str, Any]:
    """meta (a mapping or None), body, carrier, form and error of one document."""
    carrier, form, meta_text, body = split(path, text)
    out: dict[str, Any] = {"meta": None, "body": body, "carrier": carrier, "form": form, "error": None}
    if carrier:
        try:
            meta = parse_value(meta_text, form)
            out["meta"] = meta if isinstance(meta, dict) else None
            if meta is not None and not isinstance(meta, dict):
                out["error"] = "metadata is not a mapping"
        except Exception as e:  # any parser's error is the document's
            out["error"] = f"{type(e).__name__}: {str(e)[:200]}"
    return out


def link_strings(value: Any) -> list[str]:
    """A bare text, or a sequence's texts, untrimmed."""
    if isinstance(value, str):
        return [value]
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []
