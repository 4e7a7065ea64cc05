"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Words are runs of letters and digits (ASCII punctuation and white space part them), A-Z lower-cased. A posting's impact is its BM25 weight divided by the item's
own total, so a score is the share of an item's weight that a passage covers, and one threshold serves all items.

Passages are windows of two strides of words, one stride apart; a stride has at least the words of the longest item, so each
occurrence of an item lies whole in a passage. A bound is computed for all passages of a slice at once: the sums, over the passage's words,
of each term's greatest impact in each block of items, plus what the most frequent terms can add at most. Passages
whose bound reaches the threshold in some block are searched by block-max WAND; all items above the threshold are retrieved. An item
is a hit if the passage holds enough of the 5-word shingles of its question, and of its answer: its last sentence, or its last quarter if it has only one.

The index is a broadcast of bounded size: a benchmark of more than PART_WORDS words is searched in parts, which are built, sent and searched one after the other. N, the mean length, the stride and the
document frequencies are those of the whole benchmark, counted by distributed aggregates, so the number of parts changes no passage, score or hit. No documents are shuffled.

Defined cases: null and empty texts have no passages; items without words are never hit; items shorter than a shingle are compared as one whole sequence; repeated items and documents give
repeated rows of a hit; very long texts are read whole, passage by passage, and a single item of more than PART_WORDS words is a part by itself; other columns, of any name, are ignored by ``hits`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import spool

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
LEAST_STRIDE, BLOCKS = 32, 64
COMMON_SHARE = 0.25  # of an item's weight that the terms outside the block bounds may make up at most
PART_WORDS = 250_000  # of an index that travels to the tasks: some 64 MB of block bounds at most, and as much of postings


def _item_words(text: bytes) -> tuple[np.ndarray, int]:
    """The item's word hashes and the position of its answer."""
    w = textkit.words([text], textkit.PUNCTUATION)
    n = len(w.start)
    ends = [i + 1 for i in range(n - 1) if any(c in b".!?\n" for c in text[w.end[i] : w.start[i + 1]])]
    return w.hashes(), ends[-1] if ends else n - n // 4


def _shingle_set(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    if not len(h):
        return h
    return np.unique(textkit.fold([h[i : len(h) - k + 1 + i] for i in range(k)]) if len(h) >= k else textkit.fold([h[i : i + 1] for i in range(len(h))]))


@dataclass
class Posting:
    items: list[int]
    impacts: list[float]
    most: float


@dataclass(frozen=True)
class Totals:
    """Statistics of the whole benchmark: its items with words, their mean and greatest length, and how many hold each of some terms."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray  # sorted
    df: np.ndarray


class Index:
    """An inverted index of items with impacts in blocks; ``totals`` are given if the items are a part of the benchmark."""

    def __init__(self, items: list[tuple[int, str | None]], blocks: int = BLOCKS, totals: Totals | None = None):
        self.ids, self.parts, bags = [], [], []
        for item, text in sorted(((i, t) for i, t in items if i is not None), key=lambda x: x[0]):
            h, answer = _item_words((text or "").encode())
            if len(h):
                self.ids.append(item)
                self.parts.append((h[:answer], h[answer:]))
                bags.append(h)
        n = len(bags)
        self.stride = max([LEAST_STRIDE, *map(len, bags)]) if totals is None else max(LEAST_STRIDE, totals.longest)
        self.per_block = max(1, -(-n // blocks))
        self.blocks = max(1, -(-n // self.per_block))
        mean = sum(map(len, bags)) / max(1, n) if totals is None else totals.mean
        rows = []
        for i, h in enumerate(bags):
            terms, tf = np.unique(h, return_counts=True)
            rows.append((terms, np.full(len(terms), i), tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))))
        terms, owner, weight = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        self.terms, of, df = np.unique(terms, return_inverse=True, return_counts=True)
        if totals is None:
            all_items, all_df = n, df
        else:
            all_items, all_df = totals.n, totals.df[np.searchsorted(totals.terms, self.terms)]
        weight = weight * np.log(1 + (all_items - all_df + 0.5) / (all_df + 0.5))[of]
        weight = weight / np.bincount(owner, weight, minlength=max(1, n))[owner]
        order = np.lexsort((owner, of))
        owner, weight, of = owner[order], weight[order], of[order]
        bounds = np.searchsorted(of, np.arange(len(self.terms) + 1))
        self.postings = [Posting(owner[a:b].tolist(), weight[a:b].tolist(), float(weight[a:b].max())) for a, b in zip(bounds, bounds[1:], strict=False)]
        self.block_most = np.zeros((len(self.terms) + 1, self.blocks), np.float32)  # the last row: words that no item has
        np.maximum.at(self.block_most, (of, owner // self.per_block), weight.astype(np.float32))
        # The most frequent terms stay out of the block sums as long as they make up little of every item.
        common, share = np.zeros(len(self.terms) + 1, bool), np.zeros(max(1, n))
        for t in np.argsort(-df, kind="stable"):
            p = self.postings[t]
            if (share[p.items] + np.array(p.impacts)).max() > COMMON_SHARE:
                break
            share[p.items] += np.array(p.impacts)
            common[t] = True
        self.common, self.common_most = common, float(share.max())
        self.shingles = [(_shingle_set(q), _shingle_set(a)) for q, a in self.parts]
        # Words are looked up by 16 bits first, which most words that no item has fail.
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The term of each word, len(terms) for words that no item has."""
        out = np.full(len(h), len(self.terms))
        at = np.flatnonzero(self.gate[(h >> np.uint64(48)).astype(np.int64)])
        if len(at) and len(self.terms):
            t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
            same = self.terms[t] == h[at]
            out[at[same]] = t[same]
        return out

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of the items that the distinct terms cover to the threshold, by block-max WAND."""
        lists = [self.postings[t] for t in terms]
        bound = [self.block_most[t] for t in terms]
        at = [0] * len(lists)
        end, found, n = len(self.ids), [], len(self.ids)
        slack = threshold - 1e-9

        def current(j: int) -> int:
            return lists[j].items[at[j]] if at[j] < len(lists[j].items) else end

        def seek(j: int, item: int) -> None:
            at[j] = bisect_left(lists[j].items, item, at[j])

        order = sorted(range(len(lists)), key=current)
        while order:
            total, pivot = 0.0, None
            for k, j in enumerate(order):
                if current(j) >= end:
                    break
                total += lists[j].most
                if total >= slack:
                    pivot = k
                    break
            if pivot is None:
                break
            item = current(order[pivot])
            while pivot + 1 < len(order) and current(order[pivot + 1]) == item:
                pivot += 1
            block = item // self.per_block
            head = order[: pivot + 1]
            if sum(float(bound[j][block]) for j in head) < slack - 1e-5:
                # No item up to the block's end, or to the next list's item, can reach the threshold.
                to = min((block + 1) * self.per_block, current(order[pivot + 1]) if pivot + 1 < len(order) else n)
                for j in head:
                    seek(j, max(to, item + 1))
            elif current(head[0]) == item:
                score = sum(lists[j].impacts[at[j]] for j in head)
                if score >= slack:
                    found.append((item, score))
                for j in head:
                    at[j] += 1
            else:
                for j in head:
                    if current(j) < item:
                        seek(j, item)
            order = [j for j in order if current(j) < end]
            order.sort(key=current)
        return found

    def verify(self, item: int, shingles: np.ndarray) -> tuple[float, float]:
        """The shares of the question's and the answer's shingles that a passage has; 1 for an empty part."""
        return tuple(1.0 if not len(part) else float(np.isin(part, shingles).mean()) for part in self.shingles[item])

    def hits(self, texts: list[bytes], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item's id, first word of the passage, score, question's share, answer's share)."""
        w = textkit.words(texts, textkit.PUNCTUATION)
        h = w.hashes()
        term = self.lookup(h)
        n = np.diff(w.first)
        chunks = -(-n // self.stride)
        base = np.concatenate([[0], np.cumsum(chunks)])
        rare = np.flatnonzero((term < len(self.terms)) & ~self.common[term])
        doc = np.searchsorted(w.first, rare, "right") - 1
        chunk = base[doc] + (rare - w.first[doc]) // self.stride
        sums = np.zeros((int(base[-1]) + 1, self.blocks), np.float32)
        if len(rare):
            heads = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            sums[chunk[heads]] = np.add.reduceat(self.block_most[term[rare]], heads, axis=0)
        # A passage is a chunk and the next one of its text.
        last = np.zeros(len(sums), bool)
        last[base[1:][n > 0] - 1] = True
        sums[:-1] += np.where(last[:-1, None], 0, sums[1:])
        out = []
        for c in np.flatnonzero(sums[:-1].max(1, initial=0) + self.common_most >= threshold - 1e-4):
            d = int(np.searchsorted(base, c, "right") - 1)
            a = int(w.first[d] + (c - base[d]) * self.stride)
            b = min(a + 2 * self.stride, int(w.first[d + 1]))
            terms = np.unique(term[a:b])
            # The same bound again, now with each distinct term once and the frequent ones too.
            if self.block_most[terms].sum(0).max() < threshold - 1e-4:
                continue
            found = self.search(terms[terms < len(self.terms)], threshold)
            if found:
                shingles = _shingle_set(h[a:b])
                if b - a >= SHINGLE:  # parts shorter than a shingle stand for themselves
                    for k in range(1, SHINGLE):
                        shingles = np.concatenate([shingles, textkit.fold([h[a + i : b - k + 1 + i] for i in range(k)])])
                for item, score in found:
                    q, r = self.verify(item, shingles)
                    if q >= overlap and r >= overlap:
                        out.append((d, self.ids[item], a - int(w.first[d]), score, q, r))
        return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, term): a row for each distinct word of an item, and one with a null term for the item."""
    for batch in batches:
        for part, texts in textkit.slices(batch):
            w = textkit.words(texts, textkit.PUNCTUATION)
            h, n = w.hashes(), np.diff(w.first)
            some = np.flatnonzero(n)
            bags = [np.unique(h[w.first[i] : w.first[i + 1]]) for i in some]
            row = np.concatenate([some, np.repeat(some, [len(x) for x in bags])]).astype(np.int64)
            terms = pa.concat_arrays([pa.nulls(len(some), pa.int64()), textkit.int64(np.concatenate(bags) if bags else np.zeros(0, np.uint64))])
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), pa.array(n[row]), terms], names=["item_id", "words", "term"])


def _indexes(benchmark: DataFrame, part_words: int | None = None) -> Iterator[Index]:
    """Indexes of bounded size, one at a time; one alone unless the items have more than ``part_words`` words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id IS NOT NULL")
    rows = items.mapInArrow(_item_terms, "item_id long, words long, term long")
    n, words, longest = rows.where("term IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    parts = max(1, math.ceil(words / (part_words or PART_WORDS)))
    if parts == 1:
        yield Index([tuple(r) for r in items.collect()])
        return
    in_part = lambda p: F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p
    rows = spool(rows.where("term IS NOT NULL").select("item_id", "term"), "item-terms")
    df = spool(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-df")
    for p in range(parts):
        own = rows.where(in_part(p)).select("term").distinct().join(df, "term").toArrow()
        terms, counts = own.column("term").to_numpy().view(np.uint64), own.column("df").to_numpy()
        order = np.argsort(terms)
        yield Index([tuple(r) for r in items.where(in_part(p)).collect()], totals=Totals(n, words / n, longest, terms[order], counts[order]))


_HITS = "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double"


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, n_passages, score, question_overlap, answer_overlap): a row for each document and item that it holds."""
    found = []
    for index in _indexes(benchmark, part_words):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in textkit.slices(batch):
                    best: dict[tuple[int, int], list] = {}
                    for d, item, _, score, q, a in index.hits(texts, threshold, overlap):
                        old = best.setdefault((d, item), [0, 0.0, 0.0, 0.0])
                        best[d, item] = [old[0] + 1, *max((score, q, a), tuple(old[1:]))]
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[d], item, *v) for (d, item), v in best.items()]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    names = ["doc_id", "item_id", "n_passages", "score", "question_overlap", "answer_overlap"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

        if found:  # of several parts each is searched before the next one is built
            found[-1] = spool(found[-1], "hits")
        found.append(docs.select("doc_id", "text").mapInArrow(run, _HITS))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_words: int | None = None) -> DataFrame:
    """The documents that hold no item of the benchmark, unchanged; decided within the scan, so that no document moves."""
    for i, index in enumerate(_indexes(benchmark, part_words)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in textkit.slices(batch):
                    bad = {x[0] for x in index.hits(texts, threshold, overlap)}
                    yield part.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        docs = (spool(docs, "clean") if i else docs).mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
