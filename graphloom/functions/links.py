"""Links in metadata values and in prose, over Python strings; for use inside Arrow-batched parsers.

Prose links are wikilinks and inline Markdown links outside code. Spans are byte offsets of the body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_WIKI = re.compile(r"\[\[(.+?)\]\]", re.DOTALL)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_TICKS = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)


@dataclass(frozen=True)
class Link:
    target: str
    label: str | None = None
    wikilink: bool = False

    def render(self) -> str:
        if self.wikilink:
            return f"[[{self.target}|{self.label}]]" if self.label else f"[[{self.target}]]"
        target = f"<{self.target}>" if re.search(r"[ ()]", self.target) else self.target
        return f"[{self.label}]({target})" if self.label is not None else self.target


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """The target between the parentheses that open at ``at``, balanced or in angle brackets, and the position after them."""
    if text.startswith("<", at + 1):
        end = text.find(">", at + 2)
        close = text.find(")", end) if end > 0 else -1
        return (text[at + 2 : end], close + 1) if close > 0 and "\n" not in text[at:close] else None
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth == 0:
                return re.sub(r"\s+[\"'].*[\"']$", "", text[at + 1 : i].strip(), flags=re.DOTALL), i + 1
        elif text[i] == "\n":
            return None
    return None


def parse(text: str) -> Link:
    """A metadata value: a wikilink, an inline link, trailing prose aside, or a bare target."""
    s = text.strip()
    if s.startswith("[[") and (m := _WIKI.match(s)):
        target, _, label = m[1].partition("|")
        if target.strip():
            return Link(target.strip(), label.strip() or None, True)
    if s.startswith("["):
        close = s.find("](")
        if close > 0 and (found := _destination(s, close + 1)):
            return Link(found[0], s[1:close])
    return Link(s)


def code_spans(body: str) -> list[tuple[int, int]]:
    """Character spans of fenced blocks and inline code."""
    spans = [m.span() for m in _FENCE.finditer(body)]
    at, outside = 0, []
    for a, b in spans:
        outside.append((at, a))
        at = b
    outside.append((at, len(body)))
    for a, b in outside:
        spans += [m.span() for m in _TICKS.finditer(body, a, b)]
    return sorted(spans)


def body_links(body: str) -> list[tuple[Link, int, int]]:
    """(link, start, end) in byte offsets, by start; a link that overlaps an earlier one is left out."""
    code = code_spans(body)
    found: list[tuple[int, int, Link]] = []
    at = 0
    for a, b in [*code, (len(body), len(body))]:
        run = body[at:a]
        for m in _WIKI.finditer(run):
            target, _, label = m[1].partition("|")
            if target.strip():
                found.append((at + m.start(), at + m.end(), Link(target.strip(), label.strip() or None, True)))
        for m in re.finditer(r"(?<!!)\[([^\[\]]*)\]\(", run):
            if hit := _destination(run, m.end() - 1):
                found.append((at + m.start(), at + hit[1], Link(hit[0], m[1])))
        at = b
    found.sort(key=lambda x: (x[0], x[1]))
    out, last = [], 0
    for a, b, link in found:
        if a >= last and link.target:
            out.append((link, len(body[:a].encode()), len(body[:b].encode())))
            last = b
    return out
