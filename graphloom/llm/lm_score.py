"""LM scoring: a causal self-attention model over subword ids, and the corpus counts beside it.

Both learn from documents that are not held out, from all of them: the counts say how often each word occurs, each subword id, and each pair of neighbouring ids. Ids are made once, stored beside the texts, and read by
all later passes. The attention model's first weights come from SAMPLE documents chosen by a hash (of up to SAMPLE_BYTES) on the driver; then every task takes all windows of its shard of the training texts, however many these are and
long or short, through further steps, each id predicted once, and the shards' weights are averaged by their numbers of windows, ROUNDS times. Which ids have a class, a symbol or counts of their own, and which ids share a class,
follows from exact counts over all training texts.
Every whole text is scored: overlapping windows give each subword, and the end, one log-probability.

The count table grows with the corpus and stays distributed. Its head, at most HEAD words, is broadcast; words of the tail are joined by hash as
(word, row, count) rows, aggregated within a document first, and their sums return by row. One pass makes these and the scores. Words are known by 64-bit hashes.

Defined cases: null and empty texts have one token, the end; rows without an id are scored and learnt from; repeated rows count as often as they stand there, and rows that are equal in id and text get
equal scores; very long texts, and words of any length, are tokenised and scored whole; other columns, of any name, are ignored; without training rows all counts are 0 and the model gives each id the same probability in its class.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import attention, textkit
from .common import spool

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that byte-level BPE vocabularies of this family are used with, the number of ids, and the free id after them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
N_IDS = END + 1

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 19
SAMPLE, SAMPLE_BYTES, STEPS = 600, 32_768, 1500
ROUNDS = 1
SLICE = 6 << 20
WEIGHT_SLICES = 64
LONG = 1000
_PIECES = regex.compile(PATTERN)
_RUN = re.compile(rf"\S{{{LONG - 1},}}|\s{{{LONG},}}")

SLOTS = 1 << 20
_SLOT = np.uint64(SLOTS - 1)
#: Bytes that begin a character which is surely not white space.
_SOLID = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])
_CUT = re.compile(rb" (?=[\x21-\x7e\xc3-\xe0\xe4-\xf4])")
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x80, 0x100)])


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _lengths(path: str) -> np.ndarray:
    """The bytes of each id."""
    out = np.zeros(1 << 16, np.int64)
    for x, i in _ranks(path).items():
        out[i] = len(x)
    return out


@cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece of the pattern: the pair of least rank is merged, the first of equals, until none is left. A heap keeps this from taking quadratic time in long pieces."""
    n = len(piece)
    end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not live[i] or j >= n or end[j] != to:
            continue  # one of the two has been merged since
        end[i], live[j] = to, False
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


def encode(text: str, path: str = TOKENIZER) -> np.ndarray:
    """The text's subword ids. Pieces of the pattern of LONG characters or more are merged by ``merged``; the ids are the same as without it."""
    e = encoding(path)
    if len(text) < LONG or not _RUN.search(text):
        return np.array(e.encode_ordinary(text), np.int64)
    out, at = [], 0
    for m in _PIECES.finditer(text):
        if m.end() - m.start() >= LONG:
            out += e.encode_ordinary(text[at : m.start()])
            out += merged(m[0].encode(), _ranks(path))
            at = m.end()
    return np.array(out + e.encode_ordinary(text[at:]), np.int64)


def _runs_likely(texts: list[bytes]) -> np.ndarray:
    """Which texts may hold a match of _RUN; the others hold none. Characters have a byte or more, and white space is ASCII or has bytes from 0x80 on."""
    offsets = np.cumsum([0] + [len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    marked = np.zeros(len(texts), bool)
    stops = np.concatenate([[-1], np.flatnonzero(textkit._SPACE[joined]), [len(joined)]])
    for i in np.flatnonzero(np.diff(stops) >= LONG):
        marked[np.searchsorted(offsets, stops[i] + 1, "right") - 1 : np.searchsorted(offsets, stops[i + 1] - 1, "right")] = True
    step = LONG // 2  # a run of LONG bytes holds two neighbours of this grid
    white = _WHITE[joined[::step]]
    marked[np.searchsorted(offsets, np.flatnonzero(white[1:] & white[:-1]) * step, "right") - 1] = True
    return marked


def _parts(text: bytes) -> list[bytes]:
    """The text cut where segments begin, into parts of SLICE bytes or somewhat more."""
    out, at = [], 0
    while len(text) - at > SLICE and (m := _CUT.search(text, at + SLICE)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Segments:
    """The ids of texts, each distinct segment tokenised once while it is known.

    A text is cut before each single space that a character other than white space follows. There the pattern always begins a piece, whatever stands before, so the segments' ids joined are the text's.
    Known segments lie in a table of SLOTS by their 64-bit hash; where another one has the slot, or a segment is long, it is tokenised again. A slice with more than a quarter of new segments is tokenised text by text."""

    def __init__(self, path: str):
        self.path = path
        self.key, self.at, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int16)
        self.held, self.used = np.zeros(0, "<u2"), 0

    def _tokenised(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments' ids, joined, and how many each has. Short ones that begin like a cut are tokenised as one text; the ids' lengths tell where each ends."""
        together = (buf[start] == 0x20) & _SOLID[buf[np.minimum(start + 1, len(buf) - 1)]] & (end - start > 1) & (end - start <= textkit.LONG_WORD)
        length = np.where(together, end - start, 0)
        offset = np.cumsum(length) - length
        text = buf[np.repeat(start - offset, length) + np.arange(int(length.sum()))].tobytes().decode()
        joined = np.array(encoding(self.path).encode_ordinary(text), "<u2")
        ends = np.cumsum(_lengths(self.path)[joined])
        bound = np.searchsorted(ends, offset + length, "right")
        sizes = np.where(together, bound - np.searchsorted(ends, offset, "right"), 0)
        alone = np.flatnonzero(~together)
        if not len(alone):
            return joined, sizes
        raw = buf.tobytes()
        own = [encode(raw[a:b].decode(), self.path).astype("<u2") for a, b in zip(start[alone].tolist(), end[alone].tolist(), strict=True)]
        sizes[alone] = [len(x) for x in own]
        out, owner = np.empty(int(sizes.sum()), "<u2"), np.repeat(together, sizes)
        out[owner], out[~owner] = joined, np.concatenate(own)
        return out, sizes

    def _add(self, hashes: np.ndarray, ids: np.ndarray, where: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> None:
        slot = (hashes & _SLOT).astype(np.int64)
        free = np.flatnonzero(keep & (self.n[slot] == 0))
        free = free[np.unique(slot[free], return_index=True)[1]]
        n = sizes[free]
        ends = np.cumsum(n)
        self.held = np.append(self.held[: self.used], ids[np.repeat(where[free] - ends + n, n) + np.arange(int(n.sum()))])
        self.key[slot[free]], self.at[slot[free]], self.n[slot[free]] = hashes[free], self.used + ends - n, n
        self.used = len(self.held)

    def encode(self, texts: list[bytes]) -> pa.Array:
        """The ids of each text, two bytes for each id. A text longer than SLICE goes part by part, so that only one part's segments are held."""
        if len(texts) == 1 and len(parts := _parts(texts[0])) > 1:
            return pa.array([b"".join(self.encode([x])[0].as_py() for x in parts)], pa.binary())
        offsets = np.cumsum([0] + [len(t) for t in texts])
        buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        cut = np.zeros(offsets[-1] + 1, bool)
        np.logical_and(buf[: offsets[-1]] == 0x20, _SOLID[buf[1 : offsets[-1] + 1]], out=cut[:-1])
        cut[np.maximum(offsets[1:] - 1, 0)] = False  # what follows there is another text
        cut[offsets] = True
        start = np.flatnonzero(cut)
        start, end = start[:-1], start[1:]
        h = textkit.hash_spans(buf, start, end)
        slot = (h & _SLOT).astype(np.int64)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        new = np.flatnonzero((n == 0) | (self.key[slot] != h))
        held = self.held
        if len(new):
            hashes, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            if len(hashes) > max(4096, len(h) // 4):
                plain = encoding(self.path).encode_ordinary
                return pa.array([(encode(t.decode(), self.path) if runs else np.array(plain(t.decode()), "<u2")).astype("<u2", copy=False).tobytes() for t, runs in zip(texts, _runs_likely(texts).tolist(), strict=True)], pa.binary())
            first = new[first]
            ids, sizes = self._tokenised(buf, start[first], end[first])
            where = np.cumsum(sizes) - sizes
            at[new], n[new] = self.used + where[of], sizes[of]
            held = np.append(held[: self.used], ids)
            self._add(hashes, ids, where, sizes, end[first] - start[first] <= textkit.LONG_WORD)
        ends = np.cumsum(n)
        flat = held[np.repeat(at - ends + n, n) + np.arange(int(n.sum()))]
        before = np.append(0, ends)[np.searchsorted(start, offsets)] * 2
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(before.astype(np.int32)), pa.py_buffer(flat)])


@cache
def _segments(path: str) -> Segments:
    """Those of this process, for all its tasks."""
    return Segments(path)


def _encoded(path: str):
    """The rows with ``ids``, two bytes for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _segments(path)
        for batch in batches:
            for part, texts in textkit.slices(batch, most=SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, segments.encode(texts)], names=[*part.schema.names, "ids"])

    return run


def _streams(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The ids of stored texts, an end after each, in runs of about ``most``."""
    held, size = [], 0
    for batch in batches:
        for ids in batch.column("ids").to_pylist():
            held += [np.frombuffer(ids, "<u2").astype(np.int64), np.array([END])]
            size += len(held[-2]) + 1
            if size >= most:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = np.zeros(N_IDS, np.int64)
    for stream in _streams(batches):
        ids += np.bincount(stream, minlength=N_IDS)
    at = np.flatnonzero(ids)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids[at])], names=["id", "n"])


def _count_contexts(contexts: attention.Contexts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(contexts.size, np.int32)
        for stream in _streams(batches):
            at, n = np.unique(contexts.codes(np.concatenate([[END], stream])), return_counts=True)
            cells[at] += n.astype(np.int32)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at].astype(np.int64))], names=["id", "n"])

    return run


def _count_pairs(model: attention.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(attention.N_PAIRS, np.int32)
        for stream in _streams(batches, 1 << 22):  # a run costs a pass over all cells
            np.add(pairs, np.bincount(model.pairs(np.concatenate([[END], stream])), minlength=attention.N_PAIRS), out=pairs, casting="unsafe")
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pairs[at].astype(np.int64))], names=["id", "n"])

    return run


def _teach(model: attention.Model, share: int, rate: float):
    """(slice, windows, weights) of a shard: the model after its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = attention.Learner(model, rate)
        for stream in _streams(batches):
            learner.read(stream, share)
        if learner.windows:
            parts = np.array_split(attention.flat(model.p), WEIGHT_SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WEIGHT_SLICES, dtype=np.int32)), pa.array([learner.windows] * WEIGHT_SLICES, pa.int64()), pa.array([x.astype("<f4").tobytes() for x in parts], pa.binary())], names=["slice", "windows", "weights"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted sums of each slice."""
    total: dict[int, list] = {}
    for batch in batches:
        for s, n, w in zip(*(batch.column(c).to_pylist() for c in ("slice", "windows", "weights")), strict=True):
            have = total.setdefault(s, [0, 0.0])
            have[0] += n
            have[1] = have[1] + n * np.frombuffer(w, "<f4").astype(float)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([(x / n).astype("<f4").tobytes() for n, x in total.values()], pa.binary())], names=["slice", "windows", "weights"])


def teach(model: attention.Model, learn: DataFrame, share: int = 1, rounds: int = ROUNDS) -> attention.Model:
    """The model after all training texts (ids). The weights travel in slices, summed by task; the driver receives one model a round."""
    kind = "slice int, windows long, weights binary"
    for i in range(rounds):
        rows = learn.select("ids").mapInArrow(_teach(model, share, 0.003 / (i + 1)), kind)
        got = rows.repartition(WEIGHT_SLICES // 4, "slice").mapInArrow(_averaged, kind).collect()
        if got:
            by = {r["slice"]: np.frombuffer(r["weights"], "<f4") for r in got}
            model.p = attention.unflat(np.concatenate([by[k] for k in range(WEIGHT_SLICES)]), model.p)
    return model


def fold_of(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _merge(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    merged, of = np.unique(np.concatenate(words), return_inverse=True)
    return merged, np.bincount(of, np.concatenate(counts), minlength=len(merged)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of a partition, merged every few million words."""
    words, counts, held = [], [], 0

    def flush() -> pa.RecordBatch:
        w, n = _merge(words, counts)
        words.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays([textkit.int64(w), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for _, texts in textkit.slices(batch, most=SLICE):
            w, n = np.unique(textkit.words(texts).hashes(), return_counts=True)
            words.append(w)
            counts.append(n)
            held += len(w)
            if held > 2_000_000:
                yield flush()
                held = 0
    if words:
        yield flush()


def _split(head: np.ndarray, w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in the head, is it there) of all words."""
    h = w.hashes()
    unique, of = np.unique(h, return_inverse=True)
    if not len(head):
        return h, w.doc, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(head, unique), len(head) - 1)
    return h, w.doc, at[of], (head[at] == unique)[of]


def _score(head: np.ndarray, head_log: np.ndarray, end_log: float, end_known: bool, model: attention.Model):
    """A row for each text: what its head words and its subwords give, and its distinct words outside the head with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "tail_n"]
        for batch in batches:
            for part, texts in textkit.slices(batch, most=SLICE):
                w = textkit.words(texts)
                h, doc, at, known = _split(head, w)
                base = np.bincount(doc, np.where(known, head_log[at] if len(head) else 0, 0), minlength=len(texts)) + end_log
                n_known = np.bincount(doc, known, minlength=len(texts)).astype(np.int64) + end_known
                score = np.zeros(len(texts))
                ids = part.column("ids").to_pylist()
                for a in range(0, len(texts), 256):
                    score[a : a + 256] = model.score([np.frombuffer(x, "<u2").astype(np.int64) for x in ids[a : a + 256]], END) / np.log(10)
                h, doc = h[~known], doc[~known]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                first = pa.array(np.searchsorted(doc[at], np.arange(len(texts) + 1)).astype(np.int32))
                tail = [pa.ListArray.from_arrays(first, x) for x in (textkit.int64(h[at]), pa.array(np.diff(np.append(at, len(h))).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(w.first) + 1), pa.array(n_known), pa.array(base), pa.array(score), *tail], names=names)

    return run


def _table(rows: DataFrame, size: int) -> np.ndarray:
    """Counts (id, n) as an array on the driver; ``size`` is a parameter, whatever the input."""
    out = np.zeros(size, np.int64)
    got = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def score(docs: DataFrame, tokenizer: str = TOKENIZER, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document (doc_id, text)."""
    texts = docs.select("doc_id", "text", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"))
    texts = spool(texts.mapInArrow(_encoded(tokenizer), "doc_id long, text string, held_out boolean, ids binary"), "ids")
    learn = texts.where("NOT held_out")
    ids = _table(learn.select("ids").mapInArrow(_count_ids, "id int, n long"), N_IDS)
    # The sample's bound is found by rank first, so that no task sends more texts than the sample holds.
    short = learn.where(F.octet_length("text").between(1, SAMPLE_BYTES)).withColumn("rank", F.xxhash64("doc_id", F.lit(11)))
    ranks = [r["rank"] for r in short.select("rank").orderBy("rank").limit(sample).collect()]
    chosen = short.where(F.col("rank") <= ranks[-1]).select("rank", "ids").limit(2 * sample).collect() if ranks else []
    chosen = sorted((r["rank"], bytes(r["ids"])) for r in chosen)[:sample]
    contexts = attention.Contexts(ids)
    cells = _table(learn.select("ids").mapInArrow(_count_contexts(contexts), "id int, n long"), contexts.size)
    model = attention.train([np.frombuffer(t, "<u2").astype(np.int64) for _, t in chosen] or [np.zeros(0, np.int64)], N_IDS, END, steps, counts=ids, cells=cells)
    model = teach(model, learn)
    pairs = _table(learn.select("ids").mapInArrow(_count_pairs(model), "id int, n long"), attention.N_PAIRS)
    words = spool(learn.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    levels = {r["level"]: (r["words"], r["tokens"]) for r in words.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()}
    n_train = int(ids[END])  # one end for each training text
    total = sum(t for _, t in levels.values()) + n_train
    distinct = sum(n for n, _ in levels.values()) + (n_train > 0)
    norm = total + 1.0 * (distinct + 1)
    # The head are the words of the highest levels that together are no more than HEAD.
    level, room = max(levels, default=0) + 1, HEAD
    while level - 1 in levels and levels[level - 1][0] <= room or levels and level - 1 >= min(levels) and level - 1 not in levels:
        level -= 1
        room -= levels.get(level, (0, 0))[0]
    at_head = F.floor(F.log2("n") * 4).cast("int") >= level
    got = words.where(at_head).toArrow()
    head, head_n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(head)
    head, head_log = head[order], np.log10((head_n[order] + 1.0) / norm)

    model.set_counts(ids, pairs)

    end_log, end_known = float(np.log10((n_train + 1.0) / norm)), n_train > 0
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, tail_n array<int>")
    # A row's number is stored with it, so equal rows, and rows without an id, get their own sums back.
    scored = spool(texts.mapInArrow(_score(head, head_log, end_log, end_known, model), schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rows = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    joined = rows.join(words.where(~at_head).select("word", F.col("n").alias("c")), "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(1.0)) / F.lit(norm))
    sums = joined.groupBy("row").agg(F.sum(F.col("n") * log).alias("tail_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"))
    out = scored.join(sums, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
