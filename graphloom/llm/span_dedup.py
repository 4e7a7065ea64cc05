"""Substring dedup by sliding spans of sentences.

A text is cut into sentences: after ``.``, ``!`` or ``?`` before white space, and at line ends. Every run of MIN_SENTENCES consecutive sentences is hashed, however short they are.
Sentences without marks can be of any length, so they are cut further into pieces: in every window of WINDOW words of a sentence after the words with the
window's least hash, all of them if a word repeats. A cut depends on the words less than WINDOW away alone, and no piece has more than WINDOW words, so a run of
more than 50 words that stands in two places has at least one full span that is cut alike in both, whatever its words. A run of pieces is a span only if it has MIN_WORDS words too, for pieces
are a few words long and three of them recur by chance. From every piece starts one span, the shortest run with at least MIN_SENTENCES pieces and MIN_WORDS words; with ``tails``, which
the query sets, at every piece ends one as well, the shortest such run backwards, so that a repeated run is covered up to its end.
Spans are compared by the 64-bit hash of their lower-cased words over all documents. The first occurrence of a span, by doc_id, text hash and position, stays;
the pieces that any later occurrence covers are removed, within one document too.

Defined cases: null texts stay null and empty ones empty; a text without a full span is left alone; rows without an id are
not compared and stay as they are; several texts of one id are compared as documents of their own, in the order of their hashes; rows equal in id and text lose the same sentences, and
are no repetition of each other. Very long texts are read whole, one at a time. Other columns pass through, whatever their names; an input column ``n_removed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import fresh, spool

MIN_SENTENCES, MIN_WORDS, WINDOW = 3, 20, 8
#: A span is stored as its first sentence times STEP plus its number of sentences, which is at most that of its words.
STEP = max(MIN_SENTENCES, MIN_WORDS) + 1
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def window_cuts(sentence: np.ndarray, rank: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks the words whose rank is the least of a window of words that lies in one sentence, each of them on ties."""
    n = len(rank)
    chosen = np.zeros(n, bool)
    if n < window:
        return chosen
    at = np.flatnonzero(sentence[: n - window + 1] == sentence[window - 1 :])
    least = rank[at]
    for j in range(1, window):
        np.minimum(least, rank[at + j], out=least)
    for j in range(window):
        chosen[at[rank[at + j] == least] + j] = True
    return chosen


def sentences(w: textkit.Words, hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, does a sentence begin here) of every piece of a slice."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    doc = w.doc
    # A line break lies between two words if the gap holds a byte 10 or 13.
    breaks = np.concatenate([[0], np.cumsum((w.buf == 10) | (w.buf == 13))])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | _STOP[w.buf[w.end[:-1] - 1]] | (breaks[w.start[1:]] > breaks[w.end[:-1]])
    whole = new.copy()
    new[1:] |= window_cuts(np.cumsum(new), textkit.mix(hashes), window)[:-1]
    first = np.flatnonzero(new)
    return first, doc[first], whole[first]


def short_runs(first: np.ndarray, doc: np.ndarray, whole: np.ndarray, n_words: int, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(piece, piece after the run) of the runs of whole sentences with fewer words than the spans of pieces have."""
    begin, at = np.append(first, n_words), np.append(np.flatnonzero(whole), len(first))
    n = len(at) - min_sentences
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = at[:n], at[min_sentences:]
    keep = (doc[a] == doc[b - 1]) & (begin[b] - begin[a] < min_words)
    return a[keep], b[keep]


def spans(first: np.ndarray, doc: np.ndarray, hashes: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, tails: bool = False, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, piece after the span, hash) of the span that starts at each piece that has a full one, with ``tails`` of the one that ends
    at each, unless it is among the former, and of the short runs of sentences if ``whole`` tells where these begin. No two spans of one start have the same number of pieces."""
    m = len(first)
    if not m:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    begin = np.append(first, len(hashes))
    to = np.maximum(np.searchsorted(begin, begin[:m] + min_words), np.arange(m) + min_sentences)
    last = np.searchsorted(doc, doc, "right")
    ok = np.flatnonzero(to <= last)
    to = to[ok]
    if tails:
        end = np.arange(1, m + 1)
        start = np.minimum(np.searchsorted(begin, begin[1:] - min_words, "right") - 1, end - min_sentences)
        more = start >= np.searchsorted(doc, doc)
        start, end = start[more], end[more]
        shortest = np.full(m, -1)
        shortest[ok] = to
        more = shortest[start] != end
        ok, to = np.concatenate([ok, start[more]]), np.concatenate([to, end[more]])
    if whole is not None:
        start, end = short_runs(first, doc, whole, len(hashes), min_sentences, min_words)
        ok, to = np.concatenate([ok, start]), np.concatenate([to, end])
    # A polynomial hash of the words by prefix sums; the multiplier's powers are odd, so shifting it is exact modulo 2**64.
    mult, inverse = pow(0x9E3779B97F4A7C15, 1, 1 << 64), pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    n = len(hashes)
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, mult, np.uint64), dtype=np.uint64)])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)])
        total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(hashes) * up[:n], dtype=np.uint64)])
        a, b = begin[ok], begin[to]
        h = textkit.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return ok, to, h


def _spans_of(tails: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch):
                w = textkit.words(texts)
                hashes = w.hashes()
                first, doc, whole = sentences(w, hashes)
                at, to, h = spans(first, doc, hashes, tails=tails, whole=whole)
                base = np.searchsorted(doc, np.arange(len(texts)))
                row = pa.array(doc[at]) if len(at) else pa.array([], pa.int64())
                place = (at - base[doc[at]]) * STEP + to - at if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([textkit.int64(h), part.column("doc_id").take(row), part.column("sig").take(row), pa.array(place)], names=["h", "doc_id", "sig", "at"])

    return run


def _without(schema: T.StructType, cut: str):
    """Rows (documents..., cut: repeated spans) with the covered pieces removed."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch):
                cuts = part.column(cut).to_pylist()
                old = part.column("text").to_pylist()
                out, removed = list(old), [0] * len(old)
                for i, spans_of in enumerate(cuts):
                    if spans_of:
                        out[i], removed[i] = cut_out(texts[i], spans_of)
                columns = [part.column(n) if n not in ("text", "n_chars", "n_removed") else None for n in names]
                columns[names.index("text")] = pa.array(out, pa.string())
                if "n_chars" in names:
                    chars = part.column("n_chars").to_pylist()
                    columns[names.index("n_chars")] = pa.array([len(t) if r else c for t, r, c in zip(out, removed, chars, strict=True)], part.column("n_chars").type)
                columns[names.index("n_removed")] = pa.array(removed, pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_out(text: bytes, cut: list[int]) -> tuple[str, int]:
    """The text without the pieces that these spans cover, and their number."""
    w = textkit.words([text])
    first, _, _ = sentences(w, w.hashes())
    gone = np.zeros(len(first) + 1, np.int64)
    at, n = np.divmod(np.array(cut, np.int64), STEP)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + n, -1)
    gone = np.cumsum(gone)[:-1] > 0
    begin = np.append(w.start[first], len(text))
    begin[0] = 0
    kept = [text[begin[i] : begin[i + 1]] for i in range(len(first)) if not gone[i]]
    return b"".join(kept).decode().strip(), int(gone.sum())


def dedup_spans(docs: DataFrame, tails: bool = False) -> DataFrame:
    """The documents with ``text`` (and ``n_chars``, if there) shortened and ``n_removed``, the number of pieces removed.

    With ``tails`` the spans that end at each piece count too. A first shuffle counts the hashes, a second one carries the places of those that occur again; only these are ordered. Texts move once, to meet their
    cuts, which are known by id and text hash. A hash's first occurrence is a minimum aggregated before the shuffle, and the joins by hash read plain shuffles, so that a very common passage can be split.
    """
    docs = docs.drop("n_removed")
    sig = F.xxhash64("text")
    found = docs.where("doc_id IS NOT NULL").select("doc_id", sig.alias("sig"), "text").mapInArrow(_spans_of(tails), "h long, doc_id long, sig long, at long")
    repeated = spool(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    places = spool(found.join(repeated, "h", "left_semi"), "places")
    order = F.struct("doc_id", "sig", "at")
    first = spool(places.groupBy("h").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("h", "first"), "firsts")
    again = places.join(first, "h").where(order > F.col("first"))
    cut, key, text_key = fresh(docs, "cut"), fresh(docs, "cut_id"), fresh(docs, "cut_sig")
    cuts = spool(again.groupBy(F.col("doc_id").alias(key), F.col("sig").alias(text_key)).agg(F.sort_array(F.collect_set("at")).alias(cut)), "cuts")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())])
    with_id = docs.where("doc_id IS NOT NULL").join(cuts, (F.col("doc_id") == F.col(key)) & (sig == F.col(text_key)), "left").select(*docs.columns, cut)
    shortened = with_id.mapInArrow(_without(schema, cut), schema)
    return shortened.unionByName(docs.where("doc_id IS NULL").withColumn("n_removed", F.lit(0).cast("long")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_spans(docs, tails=True)
