"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over word n-grams, one of toxic and one of ordinary texts. A word after the one before it is backed off to the word alone, which is spelled in two steps, its first
5 bytes and the word given those, so that a new form of a known expression counts; each step is backed off to counts that both classes share: in how many different places (after how many different words, in texts of
either class) the word, or its stem, stands. An n-gram is counted within the class by the texts that hold it. Discounts, one each for counts of 1, 2 and more, are estimated from the class's counts of counts.
Rare expressions that the classes don't tell apart are pruned, as is usual for Kneser-Ney models: an n-gram whose log-likelihood ratio statistic (texts that hold it, by class) is below a threshold
gives all its mass to the backoff in both models, so it is smoothed by the shared counts alone. The threshold is chosen by the logistic loss on labelled texts that the models have not seen (FOLDS_OF_FIT folds).
A text's evidence is the difference of the two log-likelihoods divided by its number of words; a logistic curve of one variable, fitted on unseen labelled rows too, turns it into a score.

Training takes labelled rows of each class in the order of a hash of doc_id, at most SAMPLE, while their texts together have at most SAMPLE_BYTES; a text of any length may be among them. Nothing else
is sampled. The models are tables of bounded size, since the sample is; every whole text is scored in one pass without a shuffle.

Defined cases: null and empty texts, and texts without words, have the evidence of a word that neither class has seen; rows without an id are scored and
not held out; labels that are null, or of ids without a text, are ignored; of several texts of a labelled id the least is learnt from; repeated rows are scored each by itself, all alike; very long texts are scored whole; input columns named
score, predicted or evidence are replaced, all others pass through; without rows of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit

STEM = 5  # bytes
SAMPLE, SAMPLE_BYTES = 3000, 16 << 20
FOLDS, HELD_OUT = 5, 0
FOLDS_OF_FIT = 4
THRESHOLDS = (8.0, 16.0, 24.0, 32.0, 48.0, 64.0, 96.0, 128.0, 192.0)
SLICE = 6 << 20


def _none() -> np.ndarray:
    return np.zeros(0, np.uint64)


def fold_of(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def stem_code(stem: np.ndarray) -> np.ndarray:
    return textkit.fold([stem], 1)


def word_code(stem: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textkit.fold([stem, word], 2)


def pair_code(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textkit.fold([before, word], 3)


class Tokens:
    """The words of some texts: each different word once, with its stem, and where they stand."""

    def __init__(self, texts: list[bytes]):
        w = textkit.words(texts, textkit.PUNCTUATION)
        self.first = w.first
        self.word, at, of = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.of = of.astype(np.int32)
        self.stem = textkit.hash_spans(w.buf, w.start[at], np.minimum(w.end[at], w.start[at] + STEM))
        self.n = np.diff(w.first)

    # Made anew when asked for, since training holds the tokens of all its texts.
    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)

    @property
    def before(self) -> np.ndarray:
        """The word before, 0 at a text's begin."""
        out = np.zeros(len(self.of), np.uint64)
        out[1:] = self.word[self.of[:-1]]
        out[self.first[:-1][self.n > 0]] = 0
        return out


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return i, table[i] == keys


def _lookup(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    i, there = _at(table, keys)
    return np.where(there, values[i], 0.0) if len(table) else np.zeros(len(keys))


@dataclass
class Model:
    """Log-likelihood ratios of the n-grams that are kept, of contexts by which the others are backed off, and the logistic curve."""

    codes: np.ndarray = field(default_factory=_none)  # of stems and of words given their stems
    ratio: np.ndarray = field(default_factory=_none)
    root: float = 0.0  # of a stem that is not kept
    stems: np.ndarray = field(default_factory=_none)  # contexts of words
    of_stem: np.ndarray = field(default_factory=_none)
    pairs: np.ndarray = field(default_factory=_none)  # of a word after another: the whole ratio
    of_pair: np.ndarray = field(default_factory=_none)
    befores: np.ndarray = field(default_factory=_none)  # contexts of pairs
    of_before: np.ndarray = field(default_factory=_none)
    slope: float = 0.0
    bias: float = -40.0

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood, per word."""
        return self.of_tokens(Tokens(texts))

    def of_tokens(self, t: Tokens) -> np.ndarray:
        if not len(t.word):
            return np.full(len(t.n), self.root)
        i, kept = _at(self.codes, stem_code(t.stem))
        word = np.where(kept, self.ratio[i], self.root) if len(self.codes) else np.full(len(t.word), self.root)
        i, kept = _at(self.codes, word_code(t.stem, t.word))
        word += np.where(kept, self.ratio[i] if len(self.codes) else 0.0, _lookup(self.stems, self.of_stem, t.stem))
        value = word[t.of]
        # Only after words that are contexts of a pair that is kept does the word before count.
        opens = _at(self.befores, t.word)[1]
        near, before = np.zeros(len(value), bool), t.before
        near[1:] = opens[t.of[:-1]] & (before[1:] != 0)
        near[before == 0] = bool(_at(self.befores, np.zeros(1, np.uint64))[1][0])
        at = np.flatnonzero(near)
        if len(at):
            i, kept = _at(self.pairs, pair_code(before[at], t.word[t.of[at]]))
            value[at] = np.where(kept, self.of_pair[i] if len(self.pairs) else 0.0, value[at] + _lookup(self.befores, self.of_before, before[at]))
        total = np.concatenate([[0], np.cumsum(value)])
        return np.where(t.n > 0, (total[t.first[1:]] - total[t.first[:-1]]) / np.maximum(t.n, 1), self.root)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -500, 500)))


@dataclass
class Grams:
    """Distinct n-grams of a step with their contexts, and how many texts of each (class, fold) hold each."""

    code: np.ndarray
    context: np.ndarray  # position of the context among ``contexts``
    contexts: np.ndarray
    word: np.ndarray  # position of the word among the words, or of a word of the stem
    n: np.ndarray  # (2, folds, codes)


class Counts:
    """The n-gram counts of labelled texts: ``groups[class][fold]`` are Tokens."""

    def __init__(self, groups: list[list[Tokens]]):
        self.texts = np.array([[len(t.n) for t in folds] for folds in groups])
        each = [t for folds in groups for t in folds]
        word, at = np.unique(np.concatenate([t.word for t in each]), return_index=True)
        stem = np.concatenate([t.stem for t in each])[at]
        of = [np.searchsorted(word, t.word).astype(np.int32) for t in each]
        made = {}
        for name in ("stem", "word", "pair"):
            parts = []  # of each part: its codes, sorted, each with the number of texts that hold it, its word and its context
            for t, position in zip(each, of, strict=True):
                w, before = position[t.of], t.before if name == "pair" else None
                code = stem_code(stem)[w] if name == "stem" else word_code(stem, word)[w] if name == "word" else pair_code(before, word[w])
                doc = t.doc
                order = np.lexsort((doc, code))
                code, doc = code[order], doc[order]
                keep = np.ones(len(order), bool)
                keep[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                codes, first, n = np.unique(code[keep], return_index=True, return_counts=True)
                once = order[keep][first]
                parts.append((codes, n.astype(np.int32), w[once], before[once] if name == "pair" else None))
                del w, before, code, doc, order, keep, once
            all_codes = np.unique(np.concatenate([p[0] for p in parts]))
            # Part by part, so that no array of all n-grams stands beside another; the first part that holds a code comes last.
            n = np.zeros((len(each), len(all_codes)), np.uint16 if self.texts.max() < 1 << 16 else np.int32)
            context, words = np.zeros(len(all_codes), np.uint64), np.zeros(len(all_codes), np.int32)
            for i in reversed(range(len(each))):
                codes, held, w, before = parts.pop()
                at = np.searchsorted(all_codes, codes)
                n[i, at] = held
                words[at] = w
                context[at] = 0 if name == "stem" else stem[w] if name == "word" else before
            table, context = np.unique(context, return_inverse=True)
            made[name] = Grams(all_codes, context.astype(np.int32), table, words, n.reshape(*self.texts.shape, -1))
        self.stem, self.word, self.pair = made["stem"], made["word"], made["pair"]
        self.stem_of_word = np.searchsorted(self.stem.code, stem_code(stem))
        self.code_of_word = np.searchsorted(self.word.code, word_code(stem, word))


def discounts(n: np.ndarray) -> np.ndarray:
    """What Kneser-Ney takes off counts of 0, 1, 2 and more, by the counts of counts; no more than the count."""
    of = [int((n == k).sum()) for k in range(1, 5)]
    if not of[0]:
        return np.zeros(4)
    y = of[0] / (of[0] + 2 * of[1])
    d = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.0), k) if of[k - 1] else y for k in (1, 2, 3)]
    return np.array([0.0, *d])


def separation(n: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio statistic of n-grams: do the classes differ in the share of ``texts`` that hold it?"""
    total, out = np.maximum(texts.astype(float), 1)[:, None], np.zeros(n.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: np.where(a > 0, a * np.log(a / b), 0.0)
        for at in range(0, n.shape[1], 1 << 16):  # for the sake of memory
            x = n[:, at : at + (1 << 16)].astype(float)
            share = x.sum(0) / total.sum()
            out[at : at + (1 << 16)] = 2 * (part(x, total * share) + part(total - x, total * (1 - share))).sum(0)
    return out


def _sums(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """np.bincount with weights, in blocks, for it makes wider copies of both."""
    out = np.zeros(size)
    for at in range(0, len(n), 1 << 18):
        out += np.bincount(of[at : at + (1 << 18)], n[at : at + (1 << 18)], minlength=size)
    return out


def _smoothed(n: np.ndarray, kept: np.ndarray, context: np.ndarray, size: int, below: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each n-gram, or of those at ``only``; backoff weight of each context) of a class; ``below`` are the probabilities that they are backed off to."""
    # N-grams that are not kept lose all, the others their discount.
    d, at = discounts(n), np.flatnonzero(kept)
    total = _sums(context, n, size)
    left = total - np.bincount(context[at], n[at] - np.minimum(d[np.minimum(n[at], 3)], n[at]), minlength=size)
    weight = np.where(total > 0, np.maximum(left, 1e-3) / np.maximum(total, 1), 1.0)  # a trace is always left for what the class hasn't seen
    if only is not None:
        n, kept, context = n[only], kept[only], context[only]
    off = np.where(kept, np.minimum(d[np.minimum(n, 3)], n), n)
    return (n - off) / np.maximum(total, 1)[context] + weight[context] * below, weight


class Training:
    """The counts of all folds but ``leave``, what the classes share, and how far each n-gram tells them apart."""

    def __init__(self, c: Counts, leave: int | None = None):
        without = lambda n: n.sum(1, dtype=np.int32) - (0 if leave is None else n[:, leave].astype(np.int32))
        texts = without(c.texts)
        self.counts = c
        self.n = [without(g.n) for g in (c.stem, c.word, c.pair)]
        self.separation = [separation(n, texts) for n in self.n]
        # Shared by both classes: after how many different words a word, or a word of the stem, stands.
        places = np.bincount(c.pair.word[self.n[2].sum(0) > 0], minlength=len(c.stem_of_word)).astype(float)
        by_stem = np.bincount(c.stem_of_word, places, minlength=len(c.stem.code))
        self.shared_stem = (by_stem + 1) / (by_stem.sum() + len(by_stem) + 1)
        self.shared_word = np.zeros(len(c.word.code))
        self.shared_word[c.code_of_word] = (places + 1) / (by_stem + np.bincount(c.stem_of_word, minlength=len(by_stem)) + 1)[c.stem_of_word]


def fit(t: Training, threshold: float) -> Model:
    """The two models' ratio tables, without the curve."""
    c, (n_stem, n_word, n_pair), shared_stem, shared_word = t.counts, t.n, t.shared_stem, t.shared_word
    kept = [x >= threshold for x in t.separation]
    p_stem, root = zip(*(_smoothed(n_stem[k], kept[0], c.stem.context, 1, shared_stem) for k in (0, 1)), strict=True)
    p_word, of_stem = zip(*(_smoothed(n_word[k], kept[1], c.word.context, len(c.word.contexts), shared_word) for k in (0, 1)), strict=True)
    pairs = np.flatnonzero(kept[2])
    alone = [(p_stem[k][c.stem_of_word] * p_word[k][c.code_of_word])[c.pair.word[pairs]] for k in (0, 1)]
    p_pair, of_before = zip(*(_smoothed(n_pair[k], kept[2], c.pair.context, len(c.pair.contexts), alone[k], pairs) for k in (0, 1)), strict=True)
    ratio = lambda x: np.log(x[0]) - np.log(x[1])
    codes = np.concatenate([c.stem.code[kept[0]], c.word.code[kept[1]]])
    values = np.concatenate([ratio(p_stem)[kept[0]], ratio(p_word)[kept[1]]])
    order = np.argsort(codes)
    stems, befores = (np.unique(g.context[k]) for g, k in ((c.word, kept[1]), (c.pair, kept[2])))  # of all other contexts both weights are 1, but for the trace
    return Model(
        codes[order], values[order], float(ratio(root)[0]), c.word.contexts[stems], ratio(of_stem)[stems], c.pair.code[pairs], ratio(p_pair), c.pair.contexts[befores], ratio(of_before)[befores]
    )


def learn(each: dict[int, list[bytes]], n_labels: dict[int, int]) -> Model:
    """The model of the labelled texts of both classes, which are taken out of ``each``. Each fold is judged by a model of the others; that chooses the threshold and fits the curve."""
    n_texts = {k: len(v) for k, v in each.items()}
    groups = []
    for k in (1, 0):
        texts = each.pop(k)
        groups.append([Tokens(texts[f::FOLDS_OF_FIT]) for f in range(FOLDS_OF_FIT)])
        del texts
    counts = Counts(groups)
    size = [[len(t.n) for t in folds] for folds in groups]
    y = np.concatenate([np.full(size[k][f], 1 - k) for f in range(FOLDS_OF_FIT) for k in (0, 1)])
    # The classes count as often as they are among the labels.
    weight = np.where(y == 1, n_labels[1] / n_texts[1], n_labels[0] / n_texts[0])
    weight /= weight.mean()
    evidence: dict[float, list[np.ndarray]] = {t: [] for t in THRESHOLDS}
    for f in range(FOLDS_OF_FIT):
        training = Training(counts, f)
        for threshold, found in evidence.items():
            model = fit(training, threshold)
            # Against the evidence of words that say nothing, which differs a little from model to model.
            found += [model.of_tokens(groups[k][f]) - model.root for k in (0, 1)]
        del training, model
    del groups
    best = None
    for threshold, found in evidence.items():
        x = np.concatenate(found)
        slope, bias = fit_curve(x, y, weight)
        loss = float((weight * np.logaddexp(0, (1 - 2 * y) * (slope * x + bias))).sum())
        if best is None or loss < best[0]:
            best = (loss, threshold, slope, bias)
    # The statistic grows with the texts, so the threshold does too.
    model = fit(Training(counts), best[1] * FOLDS_OF_FIT / (FOLDS_OF_FIT - 1))
    model.slope, model.bias = best[2], best[3] - best[2] * model.root
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of one variable by Newton's method, never falling."""
    middle, scale = float(np.median(x)), max(float(x.std()), 1e-9)
    z = np.stack([(x - middle) / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), g)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(beta[0] / scale), 0.0)
    return slope, float(beta[1] - slope * middle)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out."""
    marked = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold_of(F.col("doc_id")) != HELD_OUT)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("rank", F.xxhash64("doc_id", F.lit(7)))
    chosen = None
    for kind in (1, 0):
        # Twice as many as wanted: some have no text.
        top = marked.where(F.col("toxic") == kind).orderBy("rank", "doc_id").limit(2 * sample)
        chosen = top if chosen is None else chosen.unionByName(top)
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("rank").alias("rank"), F.min("text").alias("text"))
    # At most 4 * sample rows are ranked.
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).withColumn("place", F.row_number().over(Window.partitionBy("toxic").orderBy("rank", "doc_id")))
    rows = rows.where((F.col("so_far") <= SAMPLE_BYTES) & (F.col("place") <= sample))
    each: dict[int, list[bytes]] = {1: [], 0: []}
    n_labels = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in rows.select("toxic", "rank", "doc_id", "text").orderBy("rank", "doc_id").toLocalIterator():
        each[r["toxic"]].append(r["text"].encode())
    # A text that the sample repeats is one witness.
    each = {k: list(dict.fromkeys(v)) for k, v in each.items()}
    if min(map(len, each.values())) < FOLDS_OF_FIT:
        return Model()
    return learn(each, n_labels)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents' other columns, without text, with score, predicted and n-word-normalised ``evidence``."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "score", "predicted", "evidence")]
    schema = T.StructType([*keep, T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch, most=SLICE):
                e = model.evidence(texts)
                s = model.score(e)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(e), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch, most=SLICE):
                yield part.filter(pa.array(model.score(model.evidence(texts)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
