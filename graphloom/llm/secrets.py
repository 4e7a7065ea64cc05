"""Secret scans: keyword automaton, anchored expressions near its hits, embedded checksums.

Each whole text is folded to lower case (A-Z only) and run through one Aho-Corasick automaton of keywords. Only at a hit is
the kind's regular expression matched, anchored at the keyword. Kinds whose tokens carry a checksum are then verified by it.
Runs of hexadecimal digits have no keyword; a byte-class scan finds the long ones.

Kinds, in order: assign, access and hex are the base kinds; github and npm tokens end in the base-62 CRC-32 of their
body; jwt is a token whose header decodes to JSON with an ``alg``; card is a number after a card keyword that passes Luhn's check.
Spans are code-point offsets, end exclusive, leftmost and non-overlapping within a kind.

Defined cases: null and empty texts have no spans; repeated rows are scanned each by themselves; other columns pass through ``scan``
unchanged; an input column with the name of a result column is replaced by it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit

ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[0-9A-Za-z_-]+)\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+")
_CARD = re.compile(r"card(?i:\x20?(?:number|no\.?))?\x20*[:=#]?\x20*([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.ASCII | re.IGNORECASE)


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(width, "0")


def crc_tail(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    return base62(zlib.crc32(m[1].encode()), 6) == m[2]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


#: kind -> (keywords in lower case, expression that starts with a keyword, what a match must pass)
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), _ASSIGN, lambda m: len(m[1]) >= ASSIGN_LEAST),
    "access": (("akia",), _ACCESS, lambda m: m.end() - m.start() >= ACCESS_LEAST),
    "hex": ((), None, None),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, crc_tail),
    "npm": (("npm_",), _NPM, crc_tail),
    "jwt": (("eyj",), _JWT, _jwt),
    "card": (("card",), _CARD, lambda m: luhn(re.sub(r"[ -]", "", m[1]))),
}
BASE = ("assign", "access", "hex")


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, (keywords, _, _) in KINDS.items():
        for k in keywords:
            out.add_word(k, (kind, len(k)))
    out.make_automaton()
    return out


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def hex_runs(data: np.ndarray, least: int = HEX_LEAST) -> np.ndarray:
    """(start, end) of the maximal runs of hexadecimal digits of at least so many bytes."""
    other = np.flatnonzero(~_HEX[data])
    edges = np.concatenate([[-1], other, [len(data)]])
    at = np.flatnonzero(np.diff(edges) > least)
    return np.stack([edges[at] + 1, edges[at + 1]], 1)


def find(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a UTF-8 text, ordered by start, then kind as listed."""
    # Latin-1 makes one character of each byte, so offsets are bytes until the end.
    low = text.lower().decode("latin-1")
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(low))
    runs = hex_runs(np.frombuffer(text, np.uint8))
    if not hits and not len(runs):
        return []
    raw, spans, last = text.decode("latin-1"), [], {}
    for start, kind in hits:
        _, pattern, passes = KINDS[kind]
        if start >= last.get(kind, 0) and (m := pattern.match(raw, start)):
            last[kind] = m.end()
            if passes(m):
                spans.append((kind, start, m.end()))
    spans += [("hex", int(a), int(b)) for a, b in runs]
    rank = {k: i for i, k in enumerate(KINDS)}
    spans.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
    if len(text) == len(raw) and text.isascii():
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(lead[a]), int(lead[b])) for k, a, b in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with each group of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text", result: str = "secret_spans") -> DataFrame:
    """The documents with a column of spans (kind, start, end); no shuffle, memory bounded by a batch."""
    docs = docs.drop(result)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, _SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch, text):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, _PA_SPAN)], names=[*part.schema.names, result])

    return docs.mapInArrow(run, schema)


def scrub(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every secret in ``text`` replaced by the mark and ``n_chars``, if there, brought up to date. All rows stay."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch):
                columns = part.columns
                old = columns[at].to_pylist()
                new = [redact(t, s, mark) if t and (s := find(b)) else t for t, b in zip(old, texts, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if "n_chars" in schema.names:
                    i = schema.names.index("n_chars")
                    columns[i] = pa.array([n if a is b else len(b) for n, a, b in zip(columns[i].to_pylist(), old, new, strict=True)], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "secret_spans")
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secret_spans")).alias("spans"))
