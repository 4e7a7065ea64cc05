"""N-gram Jaccard join by several global token orders, reported as linked classes.

A document's tokens are its distinct k-word shingles. Two documents link if ``100 * |A & B| >= percent * |A | B|``.

1. Equal sets fall together by a 128-bit signature; one representative of each class goes on. (Signatures, like shingles, are hashes.)
2. A sketch of token frequencies over all documents, of fixed size, gives the first global order: rare tokens first. Any total order
   is right; this one keeps common passages out of the prefixes. The other orders are by two salted hashes.
3. Under each order, linked documents share a token among the first ``n - ceil(percent * n / 100) + 1``. Representatives meet in buckets by the
   tokens of their first prefix. In a bucket of up to SMALL documents all pairs are candidates; in a larger one only the pairs with its first document.
4. Candidates must also share a prefix token under the second and the third order; the filters are intersected before any set is read. The sets of
   those that are left are compared.
5. Large buckets are grouped; groups that step 4 has joined into one component are done. In each other group, documents of different components are
   compared with each other in blocks by size, under the same three filters, so no link that would join two components is missed.

A bucket's pairs are never emitted: the rows made are linear in the prefixes. Buckets of tokens that the sketch holds very common are salted. The sketch is read by what a counter has beyond a low
quantile of all counters, which is what rare tokens that share it add up to, so a larger corpus neither makes all tokens seem common nor changes their order; tokens rarer than that sum's spread are ordered by hash.

Defined cases: rows without an id are ignored; an id in several rows counts once (of different texts the one with the least signature); a text
without words, empty or null has an empty set and is linked with nothing; very long texts are read whole, one at a time; ties of equal sets go to the least id; other columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import components, spool

SKETCH, SLICES = 1 << 20, 64  # counters and the pieces in which they travel
SMALL = 8  # a bucket up to this many documents is compared in full
HOT = 1 << 16  # tokens in more documents than this are salted
BLOCK_SHINGLES = 2_000_000  # a block of step 5
MOST_BROADCAST = 100_000  # rows of the table of size classes with several blocks, if it travels to the tasks
NOISE_QUANTILE = 0.1
BLOOM_BITS = 1 << 23
ROWS = 2_000
_ORDER2, _ORDER3 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


@dataclass(frozen=True)
class Spec:
    k: int = 5
    percent: int = 80

    def prefix(self, n):
        """Tokens that a document must show to link with any other."""
        return n - (-(-self.percent * n // 100)) + 1

    def index_prefix(self, n):
        """Tokens that it must show to link with one that is not smaller."""
        return n - (-(-2 * self.percent * n // (100 + self.percent))) + 1


def _firsts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[i], ..., first[i] + count[i] - 1 of all i."""
    total = int(count.sum())
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), textkit.int64(values))


def _signatures(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    out = np.zeros((2, len(n)), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[0, some] = np.add.reduceat(textkit.mix(h ^ _ORDER2), first[some])
        out[1, some] = np.bitwise_xor.reduceat(textkit.mix(h ^ _ORDER3), first[some])
    return out[0].view(np.int64), out[1].view(np.int64)


def _sorted_prefix(first: np.ndarray, h: np.ndarray, key: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): each set's first tokens by (key, hash)."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, key, doc))
    count = np.where(n > 0, spec.prefix(n), 0)
    return h[order][_firsts(first[:-1], count)], count


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _describe(spec: Spec, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(size, np.int64)
        names = ["doc_id", "n", "sig1", "sig2", "slice", "counts"]
        for batch in batches:
            for part, texts in textkit.slices(batch):
                first, h = textkit.words(texts).sets(spec.k)
                sketch += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
                sig1, sig2 = _signatures(first, h)
                m = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(_ids(part)), pa.array(np.diff(first)), pa.array(sig1), pa.array(sig2), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, pa.int64()) for _ in range(4)), pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in np.split(sketch, SLICES)], pa.binary())], names=names)

    return run


def _merge(kind: str):
    """Sums, or ors, the binary arrays of each slice as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(c, "<i4").astype(np.int64) if kind == "sum" else np.frombuffer(c, "<i8")
                have[s] = x if s not in have else have[s] + x if kind == "sum" else have[s] | x
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], names=["slice", "counts"])

    return run


def _merged(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """The merged array on the driver; its size is a parameter, whatever the input."""
    got = rows.select("slice", "counts").repartition(SLICES // 4, "slice").mapInArrow(_merge(kind), "slice int, counts binary").collect()
    out = np.zeros((SLICES, size // SLICES), np.int64)
    for s, c in got:
        out[s] = np.frombuffer(c, "<i8")
    return out.reshape(-1)


def excess(counts: np.ndarray) -> np.ndarray:
    """What each counter has beyond the rare tokens that share it."""
    return np.maximum(counts - np.quantile(counts, NOISE_QUANTILE).astype(np.int64), 0)


def levels(counts: np.ndarray) -> np.ndarray:
    """The first order's key of each counter: eighths of a power of two of its excess."""
    return np.floor(8 * np.log2(np.maximum(excess(counts), 1))).astype(np.uint16)


def _prefixes(spec: Spec, level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch):
                first, h = textkit.words(texts).sets(spec.k)
                sig1, _ = _signatures(first, h)
                values, count = _sorted_prefix(first, h, level[(h & np.uint64(len(level) - 1)).astype(np.int64)], spec)
                yield pa.RecordBatch.from_arrays([pa.array(_ids(part)), pa.array(np.diff(first)), pa.array(sig1), _lists(values, count)], names=["doc_id", "n", "sig1", "prefix"])

    return run


def _bucket_pairs(percent: int):
    """(a, b, kind) from rows (token, salt, size, doc) sorted in that order; size is twice the set's, and one more if the token is
    not in the index prefix: such a row pairs with smaller documents only, and before a bucket's first index row it goes. kind 0: a candidate; 1: the same, of a large bucket;
    2: of different size, but in a large bucket; 3: a is the first document of a salted part of the bucket of token b.
    A bucket ends where the sizes leap so far that no document before can link with one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, last = None, 0, 0  # the first rows of the last bucket, how many rows it has had, and the last one's size
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "size", "doc")]
            c = extra = 0
            if held is not None and held[0][0] == cols[0][0] and held[1][0] == cols[1][0] and 100 * last >= percent * (int(cols[2][0]) // 2):
                c, extra = len(held[0]), seen - len(held[0])
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            token, salt, size, doc = cols
            n, index = size // 2, size % 2 == 0
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))
            if c:
                new[1 : c + 1] = False
            # Rows before the first index row of a bucket are set aside, but in parts of a salted one, whose index rows may be in other parts.
            own = np.cumsum(new) - 1
            ahead = np.cumsum(index) - (np.cumsum(index) - index)[np.flatnonzero(new)][own] > 0
            ahead |= salt >= 0
            last_row = (token[-1], salt[-1], int(n[-1]))
            token, salt, size, n, doc, index, own = (x[ahead] for x in (token, salt, size, n, doc, index, own))
            c = min(c, len(token))
            if not len(token):
                held = None
                continue
            new = np.ones(len(token), bool)
            new[1:] = own[1:] != own[:-1]
            start = np.flatnonzero(new)
            own = np.cumsum(new) - 1
            rank = np.arange(len(token)) - start[own]
            rank[c:][own[c:] == 0] += extra
            fresh = np.arange(len(token)) >= c
            out = []

            def add(rows, other, kind):
                a, b = np.minimum(doc[rows], doc[other]), np.maximum(doc[rows], doc[other])
                fits = 100 * np.minimum(n[rows], n[other]).astype(np.int64) >= percent * np.maximum(n[rows], n[other]).astype(np.int64)
                kinds = np.where(fits, kind, 2)
                keep = (a != b) & (fits | (kind == 1))
                out.append((a[keep], b[keep], kinds[keep]))

            for k in range(SMALL - 1):
                rows = np.flatnonzero(fresh & (rank > k) & ((rank < SMALL) if k else True))
                rows = rows[index[start[own[rows]] + k]] if k else rows
                if len(rows):
                    add(rows, start[own[rows]] + k, np.where((rank[rows] >= SMALL) | (salt[rows] >= 0), 1, 0))
            turned = np.flatnonzero(fresh & (rank == SMALL) & (salt < 0))
            for k in range(1, SMALL):
                if len(turned):
                    add(start[own[turned]] + k, start[own[turned]], np.ones(len(turned), np.int64))
            heads = np.flatnonzero(fresh & (rank == 0) & (salt >= 0))
            if len(heads):
                out.append((doc[heads], token[heads], np.full(len(heads), 3)))
            at = start[-1]
            seen, last = int(rank[-1]) + 1, last_row[2]
            held = [x[at : at + SMALL] for x in (token, salt, size, doc)] if (token[at], salt[at]) == last_row[:2] else None
            a, b, kinds = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kinds, pa.int32())], names=["a", "b", "kind"])

    return run


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = textkit.mix(ids.view(np.uint64))
    return (h % np.uint64(BLOOM_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _bloom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOOM_BITS, bool)
    for batch in batches:
        for at in _bits(_ids(batch)):
            bits[at] = True
    if bits.any():
        packed = np.packbits(bits, bitorder="little").view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(packed, SLICES)], pa.binary())], names=["slice", "counts"])


def _wanted_sets(spec: Spec, packed: np.ndarray):
    """(doc_id, n, sig1, p2, p3, tokens) of the documents that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            ids = _ids(batch)
            one, two = _bits(ids)
            at = np.flatnonzero(bits[one] & bits[two])
            if not len(at):
                continue
            for part, texts in textkit.slices(batch.take(pa.array(at))):
                first, h = textkit.words(texts).sets(spec.k)
                n = np.diff(first)
                sig1, _ = _signatures(first, h)
                blobs = []
                for salt in (_ORDER2, _ORDER3):
                    values, count = _sorted_prefix(first, h, textkit.mix(h ^ salt), spec)
                    ends = np.cumsum(count)
                    blobs.append(pa.array([np.unique((values[e - c : e] >> np.uint64(32)).astype("<u4")).tobytes() for e, c in zip(ends, count, strict=True)], pa.binary()))
                sets = pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_ids(part)), pa.array(n), pa.array(sig1), *blobs, sets], names=["doc_id", "n", "sig1", "p2", "p3", "tokens"])

    return run


def _held_by(packed: np.ndarray):
    """The rows whose doc_id the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            one, two = _bits(_ids(batch))
            yield batch.filter(pa.array(bits[one] & bits[two]))

    return run


def _tokens(blob: bytes, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(blob, kind)


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _share_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [all(_meet(_tokens(x, "<u4"), _tokens(y, "<u4")) for x, y in ((a2, b2), (a3, b3))) for a2, a3, b2, b3 in zip(*(batch.column(c).to_pylist() for c in ("a2", "a3", "b2", "b3")), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = _tokens(batch.column("ta")[i].as_py()), _tokens(batch.column("tb")[i].as_py())
                m = _meet(x, y)
                keep.append(100 * m >= percent * (len(x) + len(y) - m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _postings(sets: list[np.ndarray]):
    """A function from some tokens to the positions in ``sets`` that hold them, repeated for each."""
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, docs = flat[order], docs[order]

    def of(tokens: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        return docs[_firsts(a, b - a)]

    return of


def compare_block(percent: int, level: np.ndarray, a: list[np.ndarray], b: list[np.ndarray] | None, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of a block's documents a and b (of a with itself if b is None): pairs of positions, b's after a's."""
    spec, both = Spec(0, percent), [*a, *(b or [])]
    n = np.array([len(s) for s in both])
    low, comp, links = (0 if b is None else len(a)), comp.copy(), []
    keys = (lambda s: level[(s & np.uint64(len(level) - 1)).astype(np.int64)], lambda s: textkit.mix(s ^ _ORDER2), lambda s: textkit.mix(s ^ _ORDER3))
    prefixes = [[s[np.lexsort((s, key(s)))[: spec.prefix(len(s))]] for s in both] for key in keys]
    filters, full = [_postings(p) for p in prefixes], _postings(both)
    for i in range(len(a)):
        may = comp != comp[i]
        may[:low] = False
        if b is None:
            may[: i + 1] = False
        may &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        for p, at in zip(prefixes, filters, strict=True):
            if not may.any():
                break
            shares = np.zeros(len(both), bool)
            shares[at(p[i])] = True
            may &= shares
        if may.any():
            meet = np.bincount(full(both[i]), minlength=len(both))
            for j in np.flatnonzero(may & (100 * meet >= percent * (n + n[i] - meet))):
                if comp[j] != comp[i]:
                    links.append((i, int(j)))
                    comp[comp == comp[j]] = comp[i]
    return links


def _block(percent: int, level: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "doc"], kind="stable")
        within = bool(pdf["within"].iloc[0])
        sets = [_tokens(t) for t in pdf["tokens"]]
        m = len(sets) if within else int((pdf["side"] == 0).sum())
        comp = pdf["comp"].to_numpy()
        found = compare_block(percent, level, sets[:m], None if within else sets[m:], comp)
        return pd.DataFrame([(comp[i], comp[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    return run


def _rest(spec: Spec, level: np.ndarray, grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components of each group (grp, doc, comp), by blocks of like sizes."""
    step = math.log(100 / spec.percent * 1.0001) if spec.percent < 100 else 1e-9
    docs = grouped.join(sets.select(F.col("doc_id").alias("doc"), "n"), "doc")
    docs = docs.withColumn("c", F.floor(F.log(F.col("n")) / step).cast("long") if spec.percent < 100 else F.col("n"))
    # Only the classes of more than one block are joined; they are few, so that a group's documents need not meet in one task.
    big = spool(docs.groupBy("grp", "c").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts")).where("parts > 1"), "big")
    n_big = big.count()
    for name, shift in (("parts", 0), ("up", -1), ("down", 1)):
        if n_big:
            other = big.select("grp", (F.col("c") + shift).alias("c"), F.col("parts").alias(name))
            docs = docs.join(F.broadcast(other) if n_big <= MOST_BROADCAST else other, ["grp", "c"], "left").withColumn(name, F.coalesce(name, F.lit(1)))
        else:
            docs = docs.withColumn(name, F.lit(1))
    docs = docs.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    # A task compares part i of class c with part j of the same class, j >= i, or of the next one.
    side = lambda c, i, j, within, side: F.struct(c.alias("tc"), i.alias("ti"), j.alias("tj"), F.lit(within).alias("within"), F.lit(side).alias("side"))
    c, i, one = F.col("c"), F.col("i"), F.lit(1)
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(0), n - one)).otherwise(F.array().cast("array<int>"))
    mine = F.concat(F.array(side(c, i, i, True, 0)), F.transform(F.filter(upto(F.col("parts")), lambda j: j > i), lambda j: side(c, i, j, False, 0)), F.transform(F.filter(upto(F.col("parts")), lambda j: j < i), lambda j: side(c, j, i, False, 1)))
    over = F.transform(upto(F.col("up")), lambda j: side(c, i, -j - 1, False, 0))
    under = F.transform(upto(F.col("down")), lambda j: side(c - 1, j, -i - 1, False, 1))
    tasks = docs.withColumn("t", F.explode(F.concat(mine, over, under))).select("grp", "t.*", "doc", "comp")
    keys = ["grp", "tc", "ti", "tj"]
    sides = (F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("within").alias("within"), F.min("side").alias("first"), F.max("side").alias("last"))
    useful = tasks.groupBy(*keys).agg(*sides).where("lo <> hi AND (within OR first <> last)").select(*keys)
    tasks = tasks.join(useful, keys, "left_semi").join(sets.select(F.col("doc_id").alias("doc"), "tokens"), "doc")
    return tasks.groupBy(*keys).applyInPandas(_block(spec.percent, level), "a long, b long")


def linked_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: the set's size and the least id reachable by links."""
    spec = Spec(k, percent)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    described = spool(texts.mapInArrow(_describe(spec, SKETCH), "doc_id long, n long, sig1 long, sig2 long, slice int, counts binary"), "described")
    counts = _merged(described.where("slice IS NOT NULL"), "sum", SKETCH)
    level = levels(counts)
    ids = described.where("slice IS NULL").groupBy("doc_id").agg(F.min(F.struct("n", "sig1", "sig2")).alias("s")).select("doc_id", "s.*")
    repeated = described.where("slice IS NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    # Stored, so that the join reads two plain shuffles and the rows of a large class of copies can be split.
    least = spool(ids.where("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep")), "least")
    classes = spool(ids.join(least, ["n", "sig1", "sig2"], "left").select("doc_id", "n", "sig1", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = classes.where("n > 0 AND doc_id = rep").select("doc_id", "sig1")

    over = excess(counts)
    salts = {int(i): int(over[i] // (HOT // 2)) for i in np.flatnonzero(over > HOT)}  # at most as many as the sketch has counters
    prefix = texts.mapInArrow(_prefixes(spec, level), "doc_id long, n long, sig1 long, prefix array<long>")
    rows = prefix.join(reps, ["doc_id", "sig1"], "left_semi").select("n", F.col("doc_id").alias("doc"), F.posexplode("prefix").alias("pos", "token"))
    rows = rows.withColumn("size", (2 * F.col("n") + F.when(F.expr(f"pos < n - int(ceil(2 * {percent} * n / {100 + percent}D - 1e-9)) + 1"), 0).otherwise(1)).cast("int"))
    if salts:
        table = F.broadcast(docs.sparkSession.createDataFrame(list(salts.items()), "counter long, parts int"))
        rows = rows.withColumn("counter", F.col("token").bitwiseAND(F.lit(SKETCH - 1))).join(table, "counter", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"), F.lit(-1)))
    else:
        rows = rows.withColumn("salt", F.lit(-1))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("token", "salt", "size", "doc").repartition(n_parts, "token", "salt").sortWithinPartitions("token", "salt", "size", "doc")
    pairs = spool(rows.mapInArrow(_bucket_pairs(percent), "a long, b long, kind int").groupBy("a", "b").agg(F.min("kind").alias("least"), F.max("kind").alias("most")), "pairs")
    heads = pairs.where("most = 3").select(F.col("b").alias("token"), F.col("a").alias("doc"))
    first = heads.groupBy("token").agg(F.min("doc").alias("top"))
    across = heads.join(first, "token").where("doc <> top").select(F.col("top").alias("a"), F.col("doc").alias("b"))
    large = pairs.where("most IN (1, 2)").select("a", "b").unionByName(across)
    candidates = pairs.where("least < 2").select("a", "b")

    ends = lambda e: e.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = ends(candidates).unionByName(ends(large)).distinct()
    # A filter of fixed size keeps most of the sets that nobody asks for out of the files and shuffles; the joins are exact.
    filter_of = lambda ids: _merged(ids.mapInArrow(_bloom, "slice int, counts binary"), "or", BLOOM_BITS // 64)
    sets = spool(texts.mapInArrow(_wanted_sets(spec, filter_of(wanted)), "doc_id long, n long, sig1 long, p2 binary, p3 binary, tokens binary"), "sets")
    if repeated:
        sets = sets.join(reps, ["doc_id", "sig1"], "left_semi").dropDuplicates(["doc_id"])
    token_sets = lambda ids: sets.select("doc_id", "n", "tokens").mapInArrow(_held_by(filter_of(ids)), "doc_id long, n long, tokens binary")

    def with_both(pairs: DataFrame, sets: DataFrame, *columns: tuple[str, str]) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("doc_id").alias(end), *(F.col(c).alias(name.format(end)) for c, name in columns)), end)
        return pairs

    near = spool(with_both(candidates, sets, ("p2", "{}2"), ("p3", "{}3")).select("a", "b", "a2", "a3", "b2", "b3").mapInArrow(_share_prefixes, "a long, b long"), "near")
    links = spool(with_both(near, token_sets(ends(near).distinct()), ("tokens", "t{}")).select("a", "b", "ta", "tb").mapInArrow(_linked(percent), "a long, b long"), "links")
    comp = components(links)
    if not large.isEmpty():
        group = components(large).withColumnRenamed("component", "grp")
        placed = group.join(comp, "node", "left").select("grp", F.col("node").alias("doc"), F.coalesce("component", "node").alias("comp"))
        placed = spool(placed, "placed")
        mixed = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
        open_docs = spool(placed.join(mixed, "grp", "left_semi"), "open")
        more = spool(_rest(spec, level, open_docs, spool(token_sets(open_docs.select(F.col("doc").alias("doc_id")).distinct()), "open-sets")), "more")
        if not more.isEmpty():
            known = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = components(known.where("a <> b").unionByName(more))
    out = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
