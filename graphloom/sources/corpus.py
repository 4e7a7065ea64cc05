"""A folder of text files, or a table of (path, content), as documents and edges.

Folders are listed on the driver, names alone; executors read and parse in Arrow batches. The folder must be one that all of them see.
"""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..operators.conditions import literal_texts
from . import frontmatter

DOCUMENTS = (
    "path string, dir string, kind string, carrier string, title string, title_text string, fm_id string, meta_json string, body string, texts map<string,array<string>>,"
    " links map<string,array<string>>, present array<string>, body_links array<struct<target:string,label:string,start:long,end:long>>, error string"
)


#: The default relations and pointers, and the fields that name a document's payload.
PAYLOADS = ("content", "manifest")


@dataclass(frozen=True)
class Relations:
    """Relations (name -> inverse or None), which one spans, and the one-way pointers."""

    spanning: str = "contents"
    inverses: dict[str, str | None] = field(default_factory=lambda: {"contents": "part_of", "links": "link_of"})
    pointers: tuple[str, ...] = ("registry", "config", "recycle_bin", "history", "about")

    @property
    def names(self) -> list[str]:
        out = []
        for name, inverse in self.inverses.items():
            out += [name, inverse] if inverse else [name]
        return [*out, *self.pointers]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): the files below a folder, names that begin with a dot skipped."""
    found = []
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        found += [(os.path.relpath(os.path.join(top, n), root).replace(os.sep, "/"),) for n in sorted(names) if not n.startswith(".")]
    return spark.createDataFrame(found, "path string")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read()
                yield pd.DataFrame({"path": [path], "content": [data], "size": [len(data)]})

    return list_files(spark, root).mapInPandas(run, "path string, content binary, size long")


def title_text(title) -> str | None:
    """A title as routes see it: texts as they are, numbers and truth values rendered."""
    if isinstance(title, str):
        return title
    return literal_texts(title)[0] if isinstance(title, (bool, int, float)) else None


def _row(path: str, content: bytes) -> tuple:
    folder, kind = path.rpartition("/")[0], frontmatter.kind_of(path)
    empty = (path, folder, kind, None, None, None, None, None, None, {}, {}, [], [])
    if kind == "opaque":
        return (*empty, None)
    if path.startswith("/") or posixpath.normpath(path).startswith(".."):
        return (*empty, "escapes the root")
    try:
        text = content.decode()
    except UnicodeDecodeError as e:
        return (*empty, f"not UTF-8: {e.reason}")
    d = frontmatter.parse(path, text)
    meta = d["meta"] or {}
    title, own = meta.get("title"), meta.get("id")
    body = [(x.target, x.label, a, b) for x, a, b in links.body_links(d["body"])]
    return (
        path, folder, kind, d["carrier"], title if isinstance(title, str) else None, title_text(title), own.strip() if isinstance(own, str) and own.strip() else None, json.dumps(meta, default=str) if d["meta"] is not None else None, d["body"],
        {str(k): literal_texts(v) for k, v in meta.items()}, {str(k): found for k, v in meta.items() if (found := frontmatter.link_strings(v))}, [str(k) for k in meta], body, d["error"],
    )


def documents(files: DataFrame) -> DataFrame:
    """Parses (path, content) into the document model; a file that doesn't parse keeps its row, with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in "path dir kind carrier title title_text fm_id meta_json body texts links present body_links error".split()]
        for pdf in batches:
            rows = [_row(p, bytes(c) if c is not None else b"") for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["body_links"] = [[{"target": t, "label": x, "start": a, "end": b} for t, x, a, b in r] for r in out["body_links"]]
            yield out

    return files.select("path", "content").mapInPandas(run, DOCUMENTS)


def edges(docs: DataFrame, relations: Relations = Relations()) -> DataFrame:
    """(source, site, ord, span, raw, target_text, label): metadata links by relation, then body links in order."""
    names = relations.names
    pairs = F.filter(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("site"), F.col("links")[n].alias("raws")) for i, n in enumerate(names))), lambda p: p["raws"].isNotNull())
    meta = docs.select(F.col("path").alias("source"), F.explode(pairs).alias("p")).select("source", F.col("p.site").alias("site"), F.posexplode("p.raws").alias("ord", "raw"))

    @F.pandas_udf("target string, label string")
    def parsed(raw: pd.Series) -> pd.DataFrame:
        found = [links.parse(x) for x in raw]
        return pd.DataFrame({"target": [x.target for x in found], "label": [x.label for x in found]})

    meta = meta.withColumn("l", parsed("raw")).select("source", "site", "ord", F.lit(None).cast("struct<start:long,end:long>").alias("span"), "raw", F.col("l.target").alias("target_text"), F.col("l.label").alias("label"))
    body = docs.select(F.col("path").alias("source"), F.posexplode("body_links").alias("ord", "b"))
    body = body.select("source", F.lit("body").alias("site"), "ord", F.struct(F.col("b.start").alias("start"), F.col("b.end").alias("end")).alias("span"), F.col("b.target").alias("raw"), F.col("b.target").alias("target_text"), F.col("b.label").alias("label"))
    return meta.unionByName(body)
