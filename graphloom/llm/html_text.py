"""HTML extraction by minimum-cut labelling of text blocks.

A page is cut into blocks of text at block-level elements. A logistic classifier over a block's own text (words, sentence mark, share of links), its element and the names of its ancestors
gives a logit, whose size is the capacity from the content terminal, or to the boilerplate one. Smoothness edges join blocks that follow each other, the stronger the fewer steps
lie between them in the tree and if their elements are of one kind, and blocks with the same parent. The minimum cut between the terminals, found by maximum flow, labels all blocks
at once: a one-word paragraph among paragraphs is content, a sentence among links isn't. Blocks whose terminal capacity outweighs all their edges are decided beforehand and their edges turned into
capacities of their neighbours; that changes no minimum cut and leaves small graphs.

The classifier is fitted to SAMPLE pages of the table, chosen by a hash (of up to SAMPLE_BYTES): blocks below elements that the page itself marks as its article or as something else (nav, footer, advert, ...) are its labelled rows.
Each counts twice, with the marks and without, so that the text has to tell as much as it can. Weights are pulled to PRIOR, which is also what a table without such pages gets. Names of elements are features with a weight like any other.

Character references are decoded, white space inside a block becomes one space, and the content blocks, in page order, are joined by one space.

Defined cases: a null or empty html, or one without content, gives an empty text; unclosed and stray tags, comments and quotes are read as browsers do, as far as blocks go; very long
pages take time and memory in proportion to their blocks; repeated rows are extracted each by itself, all alike; input columns named text or n_chars are replaced and that of the html goes, all others pass through, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s=\"'/>]++)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html"
    " legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_NO_TEXT = frozenset("head script style noscript template svg iframe object canvas audio video select option button datalist map title textarea xmp noembed noframes".split())
_BOILER_TAGS = frozenset("nav aside footer form menu dialog search".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead header topbar"
    " cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respondents share sharing social related recommended"
    " recommendations newsletter subscribe subscription signup login search pagination pager widget copyright legal disclaimer toolbar skip".split()
)
_HARD_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo comment comments related".split())  # also on article elements
_CONTENT_WORDS = frozenset("article content post entry story main body text".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_BOILER_STATES = frozenset(("in boilerplate", "named boilerplate", "named aside"))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: The classifier's features and their weights before any page is seen.
PRIOR = {
    "one": -1.5, "words": 1.0, "sentence": 1.0, "links": -4.0, "paragraph": 1.0, "heading": 0.5, "item": -0.5, "cell": -0.3,
    "in article": 2.0, "named content": 1.0, "in boilerplate": -3.0, "named boilerplate": -3.0, "named aside": -1.5,
}
FEATURES = tuple(PRIOR)
N_TEXT = FEATURES.index("paragraph")  # the features before this one are of the text alone
WORDS = 40  # beyond so many words a block is long
KINDS = {"p": "paragraph", "blockquote": "paragraph", "pre": "paragraph", "li": "item", "dd": "item", "dt": "item", "td": "cell", "th": "cell"} | {f"h{i}": "heading" for i in range(1, 7)}
RIDGE = 10.0  # rows that the prior weighs
SAMPLE, SAMPLE_BYTES = 300, 1 << 16
ADJACENT, SIBLING = 2.0, 0.5


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    state: str  # what the ancestors' names say: a feature, or nothing
    silent: bool


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    text: str = ""
    linked: int = 0


def _element(tag: str, attrs: str, parent: Element | None) -> Element:
    state, silent = (parent.state, parent.silent) if parent else ("", False)
    found = {}
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            if name in ("class", "id", "role", "hidden", "style", "aria-hidden") and name not in found:
                value = m[2] or ""
                found[name] = (value[1:-1] if value[:1] in "\"'" else value).lower()
    words = set(_SPLIT.split(f"{found.get('class', '')} {found.get('id', '')}")) if found else set()
    if tag in _NO_TEXT or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        silent = True
    if state not in _BOILER_STATES and tag not in ("html", "body"):
        if words & _HARD_WORDS:
            state = "named boilerplate"
        elif tag in _CONTENT_TAGS or found.get("role") in ("main", "article"):
            state = "in article"
        elif tag in _BOILER_TAGS or found.get("role") in _BOILER_ROLES or tag == "header" and state != "in article":
            state = "in boilerplate"
        elif words & _BOILER_WORDS:
            state = "named aside" if state == "in article" else "named boilerplate"
        elif words & _CONTENT_WORDS and not state:
            state = "named content"
    return Element(tag, parent, parent.depth + 1 if parent else 0, state, silent)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    root = Element("#", None, 0, "", False)
    top, out, current = root, [], None
    links = 0
    at, n = 0, len(page)

    def text(raw: str) -> None:
        nonlocal current
        if not raw or top.silent:
            return
        if current is None:
            owner = top
            while owner.tag not in _BLOCK and owner.parent is not None:
                owner = owner.parent
            # Inline elements may carry names of their own.
            current = Block(top if top.state in _BOILER_STATES and owner.state not in _BOILER_STATES else owner)
            out.append(current)
        value = html_lib.unescape(raw) if "&" in raw else raw
        current.pieces.append(value)
        if links:
            current.linked += len(value)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            if after.isalpha() or after == "/" and page[lt + 2 : lt + 3].isalpha():  # a tag that its quotes leave open
                end = page.find(">", lt)
                if end < 0:
                    break
                slash, tag, attrs = after == "/", re.match(r"</?([a-zA-Z][^\s/>]*)", page[lt:end])[1].lower(), ""
                at = end + 1
            else:
                text("<")
                at = lt + 1
                continue
        else:
            slash, tag, attrs, at = bool(m[1]), m[2].lower(), m[3], m.end()
        if slash:
            e = top
            while e.tag != tag and e.parent is not None:
                e = e.parent
            if e.parent is None:
                if tag == "p":
                    current = None
                continue
            if tag in _BLOCK or e is not top:
                current = None
            elif e.state != e.parent.state or e.silent != e.parent.silent:
                current = None
            while top is not e:
                links -= top.tag == "a"
                top = top.parent
            links -= e.tag == "a"
            top = e.parent
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                current = None
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                break
            close = page.find(">", end.start())
            at = n if close < 0 else close + 1
            continue
        if attrs.endswith("/") and tag not in _BLOCK and tag in ("path", "circle", "rect", "use", "g"):
            continue
        if tag in _BLOCK:
            current = None
            e = top
            while e.parent is not None and e.tag != "p" and e.tag not in _BLOCK:
                e = e.parent
            if e.tag == "p" and tag != "option":  # a paragraph ends where a block begins
                while top is not e:
                    links -= top.tag == "a"
                    top = top.parent
                top = e.parent
            if tag in _CLOSES:
                e = top
                while e.parent is not None and e.tag not in _SCOPE[tag] and e.tag not in _CLOSES[tag]:
                    e = e.parent
                if e.tag in _CLOSES[tag]:
                    while top is not e:
                        links -= top.tag == "a"
                        top = top.parent
                    top = e.parent
        e = _element(tag, attrs, top)
        if e.state != top.state or e.silent != top.silent:
            current = None
        top = e
        links += tag == "a"
    kept = []
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
        if b.text:
            kept.append(b)
    return kept


def features(b: Block) -> list[float]:
    row = dict.fromkeys(FEATURES, 0.0)
    row["one"] = 1.0
    row["words"] = min(b.text.count(" ") + 1, WORDS) / 10
    row["sentence"] = float(b.text[-1] in ".!?…\"'”")
    row["links"] = min(1.0, b.linked / len(b.text))
    if b.parent.tag in KINDS:
        row[KINDS[b.parent.tag]] = 1.0
    if b.parent.state:
        row[b.parent.state] = 1.0
    return list(row.values())


def logits(page: list[Block], weights: np.ndarray) -> list[float]:
    """The classifier's log-odds that each block is content."""
    return (np.array([features(b) for b in page]) @ weights).tolist()


def fit(pages: list[str]) -> np.ndarray:
    """The classifier's weights: logistic regression by Newton's method, with a ridge around PRIOR. A page's blocks together count as one page."""
    prior = np.array(list(PRIOR.values()))
    rows, labels, weight = [], [], []
    for page in pages:
        marked = [b for b in blocks(page) if b.parent.state == "in article" or b.parent.state in _BOILER_STATES]
        of = [sum((b.parent.state == "in article") == k for b in marked) for k in (False, True)]
        if min(of) == 0:
            continue  # a page with one kind alone says nothing of the difference
        for b in marked:
            y = b.parent.state == "in article"
            x = np.array(features(b))
            rows += [x, np.where(np.arange(len(x)) < N_TEXT, x, 0)]
            labels += [y, y]
            weight += [1 / of[y]] * 2
    if not rows:
        return prior
    x, y, weight = np.array(rows), np.array(labels, float), np.array(weight)
    beta = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - RIDGE * (beta - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(beta)), g)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _shared_depth(a: Element, b: Element) -> int:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, weight) of adjacent blocks and of blocks with the same parent."""
    out, last = [], {}
    for j, b in enumerate(page):
        if j:
            a = page[j - 1]
            apart = a.parent.depth + b.parent.depth - 2 * _shared_depth(a.parent, b.parent)  # 2 for elements with the same parent
            alike = 1.0 if KINDS.get(a.parent.tag) == KINDS.get(b.parent.tag) else 0.5
            out.append((j - 1, j, ADJACENT * alike / max(apart - 1, 1) ** 2))
        above = id(b.parent.parent)
        if above in last and last[above] < j - 1:
            out.append((last[above], j, SIBLING))
        last[above] = j
    return out


def minimum_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut; unary > 0 is a capacity from the content terminal.

    Minimises the sum of |unary| of the nodes against their sign and of the weights of the edges cut. Of several minimum cuts, the one with the least content.
    """
    n = len(unary)
    z = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and (z[i] > weight[i] or z[i] <= -weight[i]):
            side[i] = z[i] > weight[i]
            for j, w in near[i].items():
                if side[j] is None:
                    z[j] += w if side[i] else -w
                    weight[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, is_content in zip(rest, _flow(rest, z, near, side), strict=True):
            side[i] = is_content
    return [bool(s) for s in side]


def _flow(rest: list[int], z: list[float], near: list[dict[int, float]], side: list) -> list[bool]:
    """Dinic's maximum flow over the undecided nodes; True for those that the source still reaches."""
    index = {v: k + 2 for k, v in enumerate(rest)}
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v in rest:
        if z[v] > 0:
            add(0, index[v], z[v], 0.0)
        elif z[v] < 0:
            add(index[v], 1, -z[v], 0.0)
        for u, w in near[v].items():
            if side[u] is None and v < u:
                add(index[v], index[u], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * len(out)
        level[0] = 0
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[1] < 0:
            return [level[k + 2] >= 0 for k in range(len(rest))]
        at = [0] * len(out)
        path: list[int] = []
        v = 0
        while True:
            if v == 1:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if cap[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(out[v]):
                path.append(out[v][at[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                at[v] += 1
            else:
                break


def extract(page: str | None, weights: np.ndarray | None = None) -> str:
    """The page's main text."""
    found = blocks(page or "")
    if not found:
        return ""
    labels = minimum_cut(logits(found, np.array(list(PRIOR.values())) if weights is None else weights), edges(found))
    return " ".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def learn(pages: DataFrame, column: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """The weights for a table of pages; no more than ``sample`` pages reach the driver."""
    few = pages.select(F.col(column).alias("html")).where(F.octet_length("html").between(1, SAMPLE_BYTES)).orderBy(F.xxhash64("html"), "html").limit(sample)
    return fit([r["html"] for r in few.collect()])


def main_text(pages: DataFrame, column: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """The pages without the html, with ``text`` and ``n_chars``; no shuffle. ``weights`` are learnt from the pages unless given."""
    weights = learn(pages, column) if weights is None else weights
    keep = [f for f in pages.schema.fields if f.name.lower() not in (column.lower(), "text", "n_chars")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(p, weights) for p in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
