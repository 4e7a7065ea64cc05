"""Best-fit packing under conflicts.

Documents, measured in words, go into bins of a fixed capacity. A document longer than a bin is cut into pieces of the capacity and a rest, so that
every word is placed. No bin holds two pieces of the same source or of the same cluster of duplicates. Pieces are placed by
decreasing size: a successor search finds the bin with the least residual that is large enough and goes on to the next one
until the tightest compatible bin is found; if there is none, a new bin opens.

Bins are ordered by residual. A bin's bitmap has a bit for each of its sources and one for each of its duplicate clusters. Bins of a residual are kept by bitmap, so that those which hold
the same are passed over at once; each residual's node carries the intersection of its bitmaps, and so does each node of a segment tree over the residuals, so that runs of
bins that all hold the source, or all hold the cluster, are passed over too.

Documents are dealt to shards by a hash of their id, text key and copy number, about SHARD a shard, and each shard is packed by itself: memory follows the shard; a hot source, an id or a row that is
repeated any number of times, and rows without an id are spread over all shards. The tightest bin is that of the shard. Nothing but numbers is shuffled.

Defined cases: null and empty texts have 0 words and are in no bin (bin null, no piece); a null source or cluster conflicts with nothing; ties go to the lower id, then the lower copy, and
equal residuals to the bin that came to the residual first; repeated rows are placed as separate pieces; very long texts become pieces of the capacity; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY, SHARD = 2048, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bins:
    """Open bins by residual and bitmap, with a segment tree of the intersections of their bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaf = 1
        while self.leaf <= capacity:
            self.leaf *= 2
        self.none = -1  # all bits: what the intersection of no bin is
        self.tree = [self.none] * (2 * self.leaf)
        self.at: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]  # residual -> bitmap -> bins, in the order in which they came
        self.bits: list[int] = []
        self.residual: list[int] = []
        self.came: list[int] = []  # when each bin came to its residual
        self.clock = 0

    def _update(self, r: int) -> None:
        both = self.none
        for bits in self.at[r]:
            both &= bits
            if not both:
                break
        i = r + self.leaf
        self.tree[i] = both
        while i > 1:
            i //= 2
            both = self.tree[2 * i] & self.tree[2 * i + 1]
            if self.tree[i] == both:
                break
            self.tree[i] = both

    def _next(self, r: int, bits: int) -> int:
        """The least residual from r on whose bins don't all hold one of the bits; beyond the capacity if there is none."""
        i = r + self.leaf
        empty = self.none
        while True:
            x = self.tree[i]
            if x != empty and not x & bits:
                if i >= self.leaf:
                    return i - self.leaf
                i *= 2
                continue
            while i & 1:
                i //= 2
                if i == 0:
                    return self.capacity + 1
            if i == 0:
                return self.capacity + 1
            i += 1
            if i & (i - 1) == 0:  # past the last node of the level
                return self.capacity + 1

    def find(self, size: int, bits: int) -> int | None:
        r = size
        while r <= self.capacity:
            r = self._next(r, bits)
            if r > self.capacity:
                return None
            found = [next(iter(bins)) for held, bins in self.at[r].items() if not held & bits]
            if found:
                return min(found, key=self.came.__getitem__)
            r += 1
        return None

    def place(self, size: int, bits: int) -> int:
        """The bin of a piece; ``bits`` are those of its source and its cluster."""
        b = self.find(size, bits)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.bits.append(0)
            self.came.append(0)
        else:
            r = self.residual[b]
            same = self.at[r][self.bits[b]]
            del same[b]
            if not same:
                del self.at[r][self.bits[b]]
                self._update(r)
        self.residual[b] -= size
        self.bits[b] |= bits
        self.clock += 1
        self.came[b] = self.clock
        r = self.residual[b]
        if r:
            if self.bits[b] in self.at[r]:
                self.at[r][self.bits[b]][b] = None
            else:
                self.at[r][self.bits[b]] = {b: None}
                self._update(r)
        return b


def pack(items: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster), in the given order. Sizes are 1 to the capacity."""
    bins, bit = Bins(capacity), {}
    items = list(items)
    shared = pd.Series([c for _, _, c in items if c is not None]).value_counts()
    shared = set(shared[shared > 1].index)  # a cluster of one conflicts with nothing
    of = lambda kind, key: bit.setdefault((kind, key), 1 << len(bit))
    return [bins.place(size, (0 if source is None else of(0, source)) | (of(1, cluster) if cluster is not None and cluster in shared else 0)) for size, source, cluster in items]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cluster_of(text: Column) -> Column:
    """A key that texts share if they are equal but for white space and the case of A-Z."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")))


def _shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "cluster", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        none = lambda column: [None if pd.isna(x) else x for x in column]
        pdf["bin"] = pack(zip(pdf["size"].tolist(), none(pdf["source"]), none(pdf["cluster"]), strict=True), capacity)
        return pdf[["doc_id", "shard", "bin", "piece", "first_word", "size"]]

    return run


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, n_docs: int | None = None, cluster: Column | None = None) -> DataFrame:
    """(doc_id, shard, bin, piece, first_word, size): one row for each piece, and one with nulls for each document without words.

    ``docs`` has doc_id, text and source; ``cluster`` is a key of duplicates, equal texts unless given. Bins are numbered within a shard.
    """
    n = docs.count() if n_docs is None else n_docs
    shards = max(1, -(-n // shard))
    measured = docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), (cluster_of(F.col("text")) if cluster is None else cluster.cast("string")).alias("cluster"))
    # Equal rows are counted before they are dealt, and numbered, so that no hash holds more than its share of them.
    measured = measured.groupBy("doc_id", "source", "words", "cluster").agg(F.count(F.lit(1)).alias("copies"))
    measured = measured.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    measured = measured.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "words", "cluster", "copy"), F.lit(shards)).cast("int"))
    cap = F.lit(capacity).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("words") - 1, cap)
    pieces = measured.where("words > 0").select("doc_id", "source", "cluster", "copy", "shard", "words", F.posexplode(starts).alias("piece", "first_word"))
    pieces = pieces.select("doc_id", "source", "cluster", "copy", "shard", F.col("piece").cast("long").alias("piece"), "first_word", F.least(cap, F.col("words") - F.col("first_word")).alias("size"))
    placed = pieces.groupBy("shard").applyInPandas(_shard(capacity), "doc_id long, shard int, bin long, piece long, first_word long, size long")
    none = measured.where("words = 0").select("doc_id", "shard", *(F.lit(None).cast("long").alias(c) for c in ("bin", "piece", "first_word", "size")))
    return placed.unionByName(none)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
