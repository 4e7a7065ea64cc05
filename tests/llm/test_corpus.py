"""Operators that learn from, count over or arrange the corpus."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import attention, decontaminate, lm_score, packing, span_dedup, textkit, toxicity

from .conftest import PASSAGE


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


# packing


def naive(items, capacity):
    bins, out = [], []
    for turn, (size, source, cluster) in enumerate(items):
        fit = [(r, came, i) for i, (r, came, s, c) in enumerate(bins) if r >= size and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if fit:
            i = min(fit)[2]
        else:
            i = len(bins)
            bins.append([capacity, 0, set(), set()])
        bins[i][0] -= size
        bins[i][1] = turn
        bins[i][2].add(source)
        bins[i][3].add(cluster)
        out.append(i)
    return out


def test_best_fit_of_one_source_or_cluster_takes_linear_time():
    import time

    for items in ([(10, "s", None)] * 40_000, [(10, i % 8, "c") for i in range(40_000)], [(10 + i % 3, "s", i % 2) for i in range(40_000)]):
        began = time.perf_counter()
        assert sorted(packing.pack(items, 2048)) == list(range(40_000))
        assert time.perf_counter() - began < 10  # a walk over all bins takes minutes


def test_repeated_rows_and_rows_without_an_id_are_spread(spark):
    rows = [(7, "a b c", "s")] * 300 + [(None, f"w{i % 40} x", None) for i in range(300)]
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, source string, shard int, copy int, words int")
    placed = packing.best_fit(docs, shard=60).collect()
    assert len(placed) == 600 and sum(r["size"] for r in placed) == 1500
    shards = collections.Counter((r["doc_id"], r["shard"]) for r in placed)
    assert max(shards.values()) < 120 and len(shards) == 20


@pytest.mark.parametrize("seed", range(25))
def test_best_fit_equals_a_full_scan(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 16, 50, 64])
    items = [(r.randint(1, capacity), r.choice([None, 0, 0, 0, 1, 2, 3]), r.choice([None, *range(6)])) for _ in range(200)]
    assert packing.pack(items, capacity) == naive(items, capacity)


def test_packing_of_odd_rows(spark, odd, none):
    docs = odd.withColumnRenamed("lang", "bin").where("doc_id IS NOT NULL")
    rows = packing.best_fit(docs, capacity=2048).collect()
    texts = collections.Counter((r["doc_id"], len(words(r["text"]))) for r in odd.where("doc_id IS NOT NULL").collect())
    placed = collections.Counter()
    for r in rows:
        placed[r["doc_id"]] += r["size"] or 0
    assert placed == collections.Counter({i: sum(n * k for (j, n), k in texts.items() if j == i) for i in {j for j, _ in texts}}) | placed
    assert {r["doc_id"] for r in rows} == {i for i, _ in texts}
    bins = collections.defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in odd.collect()}
    for r in rows:
        if r["bin"] is not None:
            bins[r["shard"], r["bin"]].append(r)
    for members in bins.values():
        assert sum(r["size"] for r in members) <= 2048
        sources = [source[r["doc_id"]] for r in members if source[r["doc_id"]]]
        assert len(sources) == len(set(sources))
    assert packing.best_fit(none).count() == 0


# toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    common = [f"{a}{b}" for a in "ka lo mi nu pe".split() for b in "ra so ti wu".split()]
    bad = ["grommel", "fnarkish", "snortle", "blighter"]
    docs, labels = [], []
    for i in range(800):
        toxic = int(i % 5 == 0)
        text = [r.choice(common) for _ in range(r.randint(8, 80))]
        if toxic:
            for _ in range(max(2, len(text) // 15)):
                text.insert(r.randrange(len(text)), r.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (0, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").withColumn("held", toxicity.fold_of(F.col("doc_id")) == 0).collect()
    held = [r for r in rows if r["held"]]
    assert len(held) > 100 and sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.drop_toxic(docs, model).count() == sum(r["predicted"] == 0 for r in rows)


def test_labels_of_held_out_rows_are_never_used(labelled):
    docs, labels = labelled
    other = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert a.codes.tolist() == b.codes.tolist() and a.of_pair.tolist() == b.of_pair.tolist() and (a.slope, a.bias) == (b.slope, b.bias)


def test_expressions_of_few_texts_count(spark):
    r = random.Random(8)
    common = [f"{a}{b}{c}" for a in "ka lo mi nu pe".split() for b in "ra so ti wu".split() for c in "ba de fi".split()]
    bad = ["grommel", "fnarkish", "snortle", "blighter"]
    docs, labels = [], []
    for i in range(400):
        text = [r.choice(common) for _ in range(r.randint(20, 60))]
        if i % 8 == 0:  # no bad word is in 27 texts of the sample
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 8 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.fold_of(F.col("doc_id")) == 0).collect()
    found = [r["predicted"] for r in rows if r["toxic"]]
    assert len(found) >= 5 and sum(found) / len(found) > 0.7
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 2


def plain_kneser_ney(texts, threshold):
    """The evidence of a text by dictionaries; ``texts`` are lists of words by class."""
    stem = lambda w: w[:5]
    grams = lambda t: {("stem", "", stem(w)) for w in t} | {("word", stem(w), w) for w in t} | {("pair", v, w) for v, w in zip(["", *t], t, strict=False)}
    n = [collections.Counter(g for t in c for g in grams(t)) for c in texts]
    size = [len(c) for c in texts]
    every = set(n[0]) | set(n[1])
    places = collections.Counter(w for kind, v, w in every if kind == "pair")
    by_stem, of_stem = collections.Counter(), collections.defaultdict(set)
    for w, k in places.items():
        by_stem[stem(w)] += k
        of_stem[stem(w)].add(w)

    def statistic(g):
        share = sum(c[g] for c in n) / sum(size)
        part = lambda a, b: a * math.log(a / b) if a else 0.0
        return 2 * sum(part(c[g], m * share) + part(m - c[g], m * (1 - share)) for c, m in zip(n, size, strict=True))

    kept = {g for g in every if statistic(g) >= threshold}

    def off(c, g):
        kind, m = g[0], n[c][g]
        of = [sum(1 for x, k in n[c].items() if x[0] == kind and k == i) for i in range(1, 5)]
        if g not in kept or not m:
            return m
        if not of[0]:
            return 0
        y = of[0] / (of[0] + 2 * of[1])
        k = min(m, 3)
        return min(max(k - (k + 1) * y * of[k] / of[k - 1], 0), k) if of[k - 1] else y

    def p(c, kind, v, w):
        g = (kind, v, w)
        total = sum(k for x, k in n[c].items() if x[:2] == g[:2])
        weight = max(sum(off(c, x) for x in n[c] if x[:2] == g[:2]), 1e-3) / total if total else 1.0
        if kind == "stem":
            below = (by_stem[w] + 1) / (sum(by_stem.values()) + len(by_stem) + 1)
        elif kind == "word":
            below = (places[w] + 1) / (by_stem[v] + len(of_stem[v]) + 1)
        else:
            below = p(c, "stem", "", stem(w)) * p(c, "word", stem(w), w)
        return (n[c][g] - off(c, g)) / max(total, 1) + weight * below

    return lambda t: sum(math.log(p(0, "pair", v, w) / p(1, "pair", v, w)) for v, w in zip(["", *t], t, strict=False)) / len(t)


@pytest.mark.parametrize("threshold", [0.0, 1.5, 4.0, 1e9])
def test_evidence_equals_plain_kneser_ney(threshold):
    r = random.Random(21)
    words_of = [[f"{a}{b}" for a in ("grommel", "fnark", "ka", "lo") for b in ("", "s", "ish")] for _ in range(2)]
    texts = [[[r.choice(words_of[c][c * 3 :]) for _ in range(r.randint(1, 12))] for _ in range(20 + 10 * c)] for c in (0, 1)]
    tokens = [[toxicity.Tokens([" ".join(t).encode() for t in texts[c][f::4]]) for f in range(4)] for c in (0, 1)]
    model = toxicity.fit(toxicity.Training(toxicity.Counts(tokens)), threshold)
    plain = plain_kneser_ney(texts, threshold)
    known = {v for c in texts for t in c for v in t}
    sample = texts[0][:6] + texts[1][:6] + [["ka", "zzz"] if threshold > 10 else ["ka", "los"]]
    assert known and np.allclose(model.evidence([" ".join(t).encode() for t in sample]), [plain(t) for t in sample], atol=2e-3)


def test_training_holds_few_bytes_a_word():
    import tracemalloc

    r = np.random.default_rng(11)
    vocabulary = np.array([f"{a}{b}" for a in range(100) for b in "abcdefghij"])
    each = {k: [" ".join(vocabulary[(r.random(200) ** 2 * 1000).astype(int)]).encode() for _ in range(1000)] for k in (1, 0)}
    tracemalloc.start()
    try:
        toxicity.learn(each, {1: 1000, 0: 1000})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * 400_000, peak / 400_000


def test_toxicity_of_odd_rows(spark, odd, none, labelled):
    model = toxicity.train(*labelled)
    rows = toxicity.score(odd.withColumnRenamed("lang", "score"), model).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0.5 for r in rows if r["doc_id"] in (1, 2, 3))
    untrained = toxicity.train(none, labelled[1])
    assert all(r["predicted"] == 0 for r in toxicity.score(odd, untrained).collect()) and toxicity.score(none, model).count() == 0


# language model


def test_windows_score_each_token_once():
    r = np.random.default_rng(1)
    texts = [r.integers(0, 300, n) for n in (0, 1, 35, 36, 37, 71, 72, 200)] * 3
    model = attention.train([t for t in texts if len(t)], 301, 300, steps=5)
    model.set_counts(np.ones(301), r.integers(0, 3, attention.N_PAIRS))
    together = model.score(texts, 300)
    assert np.allclose(together, [model.score([t], 300)[0] for t in texts])
    # By hand: each id from the window that scores it.
    lead, w, s = attention.WINDOW - attention.STRIDE, attention.WINDOW, attention.STRIDE
    for t, total in zip(texts[:8], together, strict=False):
        stream = np.concatenate([np.full(lead + 1, 300), t, [300], np.full(w, 300)])
        value = 0.0
        for k in range(len(t) + 1):
            a = k // s * s
            row = model.class_log(model.symbol[stream[a : a + w]][None], model.cls[stream[a + lead + 1 : a + w + 1]][None])
            target = stream[lead + 1 + k]
            value += row[0, k - a] + model.log_in[target] + model.after[model.row[stream[lead + k]], model.column[target]]
        assert math.isclose(value, total, rel_tol=1e-4)


def test_class_probabilities_and_gradients():
    r = np.random.default_rng(2)
    model = attention.train([r.integers(0, 300, 500)], 301, 300, steps=5)
    symbols = model.symbol[r.integers(0, 300, (1, attention.WINDOW))]
    total = sum(np.exp(model.class_log(symbols, np.full((1, attention.STRIDE), c))) for c in range(attention.CLASSES))
    assert np.allclose(total, 1, atol=1e-3)
    model.set_counts(r.integers(0, 9, 301).astype(float))
    assert np.allclose(np.bincount(model.cls, np.exp(model.log_in.astype(float)), minlength=attention.CLASSES)[np.unique(model.cls)], 1, atol=1e-4)
    stream = r.integers(0, 300, 4000)
    model.set_counts(np.bincount(stream, minlength=301), np.bincount(model.pairs(stream), minlength=attention.N_PAIRS))
    for before in (3, 77, 300):  # after any id, the ids of a class share all its probability
        p = np.exp(model.log_in.astype(float) + model.after[model.row[before], model.column])
        assert np.allclose(np.bincount(model.cls, p, minlength=attention.CLASSES)[np.unique(model.cls)], 1, atol=1e-4)
    p = {k: v.astype(float) for k, v in model.p.items()}
    s, t = r.integers(0, 200, (2, attention.WINDOW)), r.integers(0, attention.CLASSES, (2, attention.WINDOW))
    _, g = attention._loss(p, s, t)
    for k in p:
        at = (s[0, 3], 2) if k == "E" else tuple(r.integers(0, d) for d in p[k].shape)
        keep = p[k][at]
        p[k][at] = keep + 1e-5
        up = attention._loss(p, s, t)[0]
        p[k][at] = keep - 1e-5
        down = attention._loss(p, s, t)[0]
        p[k][at] = keep
        assert math.isclose((up - down) / 2e-5, float(g[k][at]), rel_tol=1e-3, abs_tol=1e-6)


@pytest.mark.parametrize("head", [0, 5, 1 << 19])
def test_base_scores_equal_plain_counts(spark, odd, head, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", head)
    rows = lm_score.score(odd, steps=5).collect()
    data = odd.collect()
    train = [r for r in data if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    counts = collections.Counter(w for r in train for w in words(r["text"]))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    expected = collections.Counter()
    for r in data:
        w = words(r["text"])
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        expected[r["doc_id"], held, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(log(counts[x]) for x in w) + log(len(train)), 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows) and len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1


def test_lm_of_an_empty_table(none):
    assert lm_score.score(none, steps=2).count() == 0


def test_long_runs_have_the_ids_of_the_tokenizer():
    import time

    r = random.Random(12)
    ranks = lm_score._ranks(lm_score.TOKENIZER)
    plain = lambda t: lm_score.encoding(lm_score.TOKENIZER).encode_ordinary(t)
    for _ in range(30):
        piece = " " + "".join(r.choice("aeinrstxé漢") for _ in range(r.randint(1, 300)))
        assert lm_score.merged(piece.encode(), ranks) == plain(piece)
    for text in ("a b " + "x" * 2500 + " c", "a  " + "ab" * 800 + "1" * 1500 + " " * 1200 + "z\n", "!" * 1100 + "er" * 700 + " the end"):
        assert lm_score.encode(text).tolist() == plain(text)
    began = time.perf_counter()
    long = "".join(r.choice("aeinrst") for _ in range(200_000))
    assert lm_score.encoding(lm_score.TOKENIZER).decode(lm_score.encode(long).tolist()) == long and time.perf_counter() - began < 30


def test_all_training_texts_teach(spark):
    """Averaged over the shards, one pass lowers the loss on texts of a kind that the first texts lack."""
    r = np.random.default_rng(4)
    first = [r.integers(0, 50, 300) for _ in range(30)]
    model = attention.train(first, lm_score.N_IDS, lm_score.END, steps=60, counts=np.bincount(np.tile(np.arange(120), 9), minlength=lm_score.N_IDS))
    later = [np.tile(r.permutation(60)[:4] + 60, 80) for _ in range(200)]
    rows = spark.createDataFrame([(bytearray(t.astype("<u2").tobytes()),) for t in later[:160]], "ids binary").repartition(3)
    model.set_counts(np.ones(lm_score.N_IDS))
    before = model.score(later[160:], lm_score.END).sum()
    lm_score.teach(model, rows, share=1, rounds=2)
    assert model.score(later[160:], lm_score.END).sum() > before + 100
    assert lm_score.teach(model, rows.limit(0)) is model



def test_equal_texts_score_equally_anywhere():
    r = np.random.default_rng(10)
    model = attention.train([r.integers(0, 300, 5000)], 301, 300, steps=20)
    model.set_counts(np.ones(301), r.integers(0, 3, attention.N_PAIRS))
    text = r.integers(0, 300, 700)
    scores = set()
    for k in range(40):
        texts = [r.integers(0, 300, n) for n in r.integers(0, 400, k)]
        at = int(r.integers(0, k + 1))
        scores.add(float(model.score([*texts[:at], text, *texts[at:]], 300)[at]))
    assert len(scores) == 1


def test_each_id_of_a_stream_is_predicted_once(monkeypatch):
    r = np.random.default_rng(6)
    model = attention.train([r.integers(0, 300, 500)], 301, 300, steps=2)
    model.cls = model.symbol = np.arange(301)
    seen = []
    monkeypatch.setattr(attention.Learner, "step", lambda self, symbols, classes, rate: seen.append((symbols, classes)))
    stream = np.append(r.permutation(300)[: attention.WINDOW * 5], 300)[-attention.WINDOW * 5 :]
    attention.Learner(model, 0.01).read(stream, 1)
    symbols, classes = (np.concatenate(x) for x in zip(*seen, strict=True))
    assert sorted(classes.ravel().tolist()) == sorted(stream.tolist())
    before = dict(zip(stream.tolist(), [300, *stream[:-1].tolist()], strict=True))
    assert all(before[b] == a for a, b in zip(symbols.ravel().tolist(), classes.ravel().tolist(), strict=True))
    for n in (1, 30, 48, 49, 500):  # a last window may begin earlier
        seen.clear()
        stream = r.permutation(300)[:n] if n < 300 else np.arange(n) % 300
        attention.Learner(model, 0.01).read(stream, 1)
        assert set(stream.tolist()) <= set(np.concatenate([c for _, c in seen]).ravel().tolist()) and sum(map(len, (c for _, c in seen))) == -(-n // attention.WINDOW)


def test_the_query_teaches_all_windows():
    import inspect

    r = np.random.default_rng(7)
    model = attention.train([r.integers(0, 300, 500)], lm_score.N_IDS, lm_score.END, steps=2)
    texts = [r.integers(0, 300, n) for n in (0, 5, 3000, 70, 9000)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())], names=["ids"])
    share = inspect.signature(lm_score.teach).parameters["share"].default
    taught = next(lm_score._teach(model, share, 0.002)(iter([batch])))
    assert taught.column("windows")[0].as_py() == -(-sum(len(t) + 1 for t in texts) // attention.WINDOW)


def test_classes_follow_from_all_contexts():
    """Ids that the sample lacks are classed by what they follow in the training texts."""
    r = np.random.default_rng(8)
    n = 1200
    stream = np.empty(120_000, np.int64)
    stream[::2] = r.integers(0, 2, 60_000)  # one of two common ids, and after each an id of its own half
    stream[1::2] = 200 + 2 * r.integers(0, 500, 60_000) + stream[::2]
    counts = np.bincount(stream, minlength=n)
    at = attention.Contexts(counts)
    cells = np.bincount(at.codes(stream), minlength=at.size)
    cls, _ = attention.classify(stream[:100], n, np.random.default_rng(1), counts, cells)
    shared = at.rest[counts[at.rest] > 20]
    assert len(shared) > 500 and not set(cls[shared[shared % 2 == 0]]) & set(cls[shared[shared % 2 == 1]])
    whole, _ = attention.classify(stream, n, np.random.default_rng(1), counts)
    assert (whole == cls).all()


def test_gradients_where_exponentials_overflow():
    r = np.random.default_rng(9)
    model = attention.train([r.integers(0, 300, 500)], 301, 300, steps=5)
    s, t = r.integers(0, 200, (2, attention.WINDOW)), r.integers(0, attention.CLASSES, (2, attention.WINDOW))
    for name, by in (("Q", 300), ("U", 300)):
        p = {k: v * np.float32(by if k == name else 1) for k, v in model.p.items()}
        loss, g = attention._loss(p, s, t)
        exact, h = attention._loss({k: v.astype(float) for k, v in p.items()}, s, t)
        assert math.isclose(loss, exact, rel_tol=1e-3) and all(np.isfinite(g[k]).all() and np.abs(g[k] - h[k]).max() <= 0.02 * np.abs(h[k]).max() for k in g)


def test_each_segment_is_tokenised_once(monkeypatch):
    """Ids from segments are those of whole texts, whatever white space and signs stand at the cuts, and repeated segments cost the tokenizer nothing."""
    r = random.Random(13)
    plain = lm_score.encoding(lm_score.TOKENIZER).encode_ordinary
    signs = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u180e", "\u200b", "\x00", "a", "b'", "'s", "'ll", "\xe9", "\u6f22\u5b57", "7", "12", "!", "--", "\U0001f600", "\u03a9", " xxx"]
    for slots in (lm_score.SLOTS, 8):  # with few slots most segments aren't kept
        monkeypatch.setattr(lm_score, "SLOTS", slots)
        monkeypatch.setattr(lm_score, "_SLOT", np.uint64(slots - 1))
        segments = lm_score.Segments(lm_score.TOKENIZER)
        for _ in range(6):
            texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["", " ", "a ", " a", "x" * 2500 + " b", " " * 1500 + "z", " " + "y" * 300 + " y"]
            for _ in range(2):
                assert segments.encode([t.encode() for t in texts]).to_pylist() == [np.array(plain(t), "<u2").tobytes() for t in texts]
    monkeypatch.setattr(lm_score, "SLICE", 9)  # long texts go part by part
    for t in ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(300)]:
        assert segments.encode([t.encode()]).to_pylist() == [np.array(plain(t), "<u2").tobytes()]
    assert len(lm_score._parts(b"one two three four five six")) == 3
    rare = [" ".join("%x" % r.getrandbits(60) for _ in range(9000)).encode()]
    assert segments.encode(rare).to_pylist() == [np.array(plain(rare[0].decode()), "<u2").tobytes()]
    monkeypatch.undo()
    words, read = ["".join(r.choice("aeinrst") for _ in range(8)) for _ in range(50)], []
    own = lm_score.encoding(lm_score.TOKENIZER)

    class Counting:
        def encode_ordinary(self, text):
            read.append(len(text))
            return own.encode_ordinary(text)

    monkeypatch.setattr(lm_score, "encoding", lambda path: Counting())
    texts = [" ".join(r.choice(words) for _ in range(400)).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], names=["text"])
    got = next(lm_score._encoded(lm_score.TOKENIZER)(iter([batch]))).column("ids").to_pylist()
    assert got == [np.array(plain(t.decode()), "<u2").tobytes() for t in texts] and sum(read) < sum(map(len, texts)) / 50


def test_classes_of_a_group_are_predicted_after_the_group():
    """Scores and losses equal a plain model in two steps, and no position meets all classes."""
    r = np.random.default_rng(14)
    model = attention.train([r.integers(0, 300, 4000)], 301, 300, steps=20)
    p, d, w = {k: v.astype(float) for k, v in model.p.items()}, attention.DIM, attention.WINDOW
    s, t = model.symbol[r.integers(0, 300, (3, w))], r.integers(0, attention.CLASSES, (3, w))
    edges, log = [*attention.TAIL, attention.CLASSES], np.zeros((3, w))
    for n in range(3):
        x = p["E"][s[n]] + p["P"]
        for i in range(w):
            a = np.exp(x[: i + 1] @ p["K"] @ (x[i] @ p["Q"]) / math.sqrt(d))
            h = x[i] + a / a.sum() @ x[: i + 1] @ p["V"] @ p["O"]
            h = h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]
            z = np.exp(h @ p["U"] + p["b"])
            groups, classes = z[: attention.GROUPS], z[attention.GROUPS :]
            top = groups.sum() + classes[: edges[0]].sum()
            g = sum(t[n, i] >= e for e in edges) - 1
            log[n, i] = math.log(classes[t[n, i]] / top if g < 0 else groups[g] / top * classes[t[n, i]] / classes[edges[g] : edges[g + 1]].sum())
    assert math.isclose(attention._loss(p, s, t)[0], -log.mean(), rel_tol=1e-9)
    assert np.allclose(model.class_log(s, t[:, w - attention.STRIDE :]), log[:, w - attention.STRIDE :], atol=1e-4)
    assert attention.TOP + max(b - a for a, b in attention.SPANS) < attention.CLASSES / 2


# spans


def sentences_of(text):
    w = textkit.words([text.encode()])
    first, _, whole = span_dedup.sentences(w, w.hashes())
    n = len(first)
    return words(text), [*first.tolist(), len(w.start)], [*(i for i in range(n) if whole[i]), n]


def short_runs(f, starts):
    """Runs of whole sentences that have fewer words than a span of pieces."""
    k = span_dedup.MIN_SENTENCES
    return {(a, b) for a, b in zip(starts, starts[k:], strict=False) if f[b] - f[a] < span_dedup.MIN_WORDS}


def brute_spans(rows):
    """Sentences removed from each (doc_id, text) by comparing word tuples."""
    seen, out = {}, {}
    for i, text in sorted((i, t or "") for i, t in rows):
        w, f, starts = sentences_of(text)
        gone, runs = set(), short_runs(f, starts)
        for a in range(len(f) - 1):
            b = a + span_dedup.MIN_SENTENCES
            while b < len(f) and f[b] - f[a] < span_dedup.MIN_WORDS:
                b += 1
            if b < len(f):
                runs.add((a, b))
        for a, b in sorted(runs):
            if seen.setdefault(tuple(w[f[a] : f[b]]), (i, a)) != (i, a):
                gone |= set(range(a, b))
        out[i] = (len(gone), [w[f[s] : f[s + 1]] for s in range(len(f) - 1) if s not in gone])
    return out


def test_repeated_spans_equal_brute_force(spark):
    r = random.Random(4)
    sentence = lambda: " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.choice([1, 3, 8, 20, 45]))) + r.choice([".", "!", "?", "\n"])
    shared = [[sentence() for _ in range(r.randint(3, 9))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = [sentence() for _ in range(r.randint(0, 10))]
        for _ in range(r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(text))
            text[at:at] = r.choice(shared)
        rows.append((i, " ".join(text)))
    expected = brute_spans(rows)
    got = {x["doc_id"]: x for x in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i]["n_removed"] == expected[i][0]
        assert words(got[i]["text"]) == [w for s in expected[i][1] for w in s]
        if not expected[i][0]:
            assert got[i]["text"] == text


def test_spans_of_odd_rows(odd, none):
    rows = span_dedup.dedup_spans(odd.withColumnRenamed("lang", "n_removed")).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["text"] is None and by_id[2]["text"] == "" and by_id[5]["text"] == PASSAGE and by_id[6]["n_removed"] > 0 and by_id[None]["n_removed"] == 0
    assert len({(r["text"], r["n_removed"]) for r in rows if r["doc_id"] == 6}) == 1 and span_dedup.dedup_spans(none).count() == 0


def test_three_short_sentences_are_a_span(spark):
    rows = [(1, "Yes. No. Well. Then something else came of it"), (2, "It began. Yes. No. Well. And it went on"), (3, "Yes. No. And it went elsewhere")]
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("It began. And it went on", 3), 3: (rows[2][1], 0)}


def test_ids_with_several_texts_are_cut_row_by_row(spark):
    rows = [(1, PASSAGE), (2, "Some words before. " + PASSAGE), (2, "Short text. Only two."), (2, PASSAGE), (2, PASSAGE), (None, PASSAGE)]
    docs = spark.createDataFrame([(i, t, "a", "b", len(t)) for i, t in rows], "doc_id long, text string, __cut string, cut_id string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"], r["n_removed"] > 0, r["__cut"], r["n_chars"] == len(r["text"])) for r in span_dedup.dedup_spans(docs, tails=True).collect())
    assert got == collections.Counter({(1, PASSAGE, False, "a", True): 1, (2, "Some words before.", True, "a", True): 1, (2, "Short text. Only two.", False, "a", True): 1, (2, "", True, "a", True): 2, (None, PASSAGE, False, "a", True): 1})


@pytest.mark.parametrize("vocabulary", [["of"], ["and"], ["to", "in"], ["a", "of", "and"], None])
def test_any_run_of_over_50_words_has_a_common_span(spark, vocabulary):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 10**6)}"
    rows = []
    for i in range(40):
        run = [r.choice(vocabulary) if vocabulary else word() for _ in range(51)]
        if vocabulary and len(vocabulary) == 1:
            run = vocabulary * 51
        if i % 2:  # sentences of any length, cut anywhere by the run's ends
            for at in range(r.randint(0, 12), 51, r.randint(5, 20)):
                run[at] += "."
        texts = [" ".join([word() for _ in range(r.randint(0, 15))] + run + [word() for _ in range(r.randint(0, 15))]) for _ in range(2)]
        found = []
        for text in texts:
            w = textkit.words([text.encode()])
            first, doc, _ = span_dedup.sentences(w, w.hashes())
            found.append(set(span_dedup.spans(first, doc, w.hashes())[2].tolist()))
        assert found[0] & found[1]
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
    got = span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x["n_removed"] > 0 for x in got if x["doc_id"] % 2)


def brute_tails(rows):
    """As brute_spans, with the shortest run that ends at each sentence besides the one that starts there."""
    seen, gone, cut = {}, {}, {}
    for i, text in rows:
        w, f, starts = sentences_of(text)
        cut[i] = w, f
        m, gone[i] = len(f) - 1, set()
        full = lambda a, b: b - a >= span_dedup.MIN_SENTENCES and f[b] - f[a] >= span_dedup.MIN_WORDS
        forward = [(a, next((b for b in range(a, m + 1) if full(a, b)), None)) for a in range(m)]
        backward = [(next((a for a in range(b, -1, -1) if full(a, b)), None), b) for b in range(1, m + 1)]
        for a, b in {x for x in forward + backward if None not in x} | short_runs(f, starts):
            seen.setdefault(tuple(w[f[a] : f[b]]), []).append((i, a, b))
    for found in seen.values():
        for i, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b))
    return {i: (len(gone[i]), [w[f[s] : f[s + 1]] for s in range(len(f) - 1) if s not in gone[i]]) for i, (w, f) in cut.items()}


def test_repeated_runs_are_removed_to_their_end(spark, tmp_path):
    r = random.Random(6)
    sentence = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    run = ". ".join(map(sentence, (7, 7, 7, 1, 1, 2))) + "."
    rows = [(1, f"{sentence(7)}. {run} {sentence(30)}"), (2, f"{run} {sentence(25)}")]
    shared = [[sentence(r.choice([1, 2, 3, 7, 20])) + "." for _ in range(r.randint(3, 12))] for _ in range(6)]
    for i in range(3, 120):
        text = [sentence(r.choice([1, 3, 8, 20])) + "." for _ in range(r.randint(0, 8))]
        for _ in range(r.choice([0, 1, 2])):
            at = r.randint(0, len(text))
            text[at:at] = r.choice(shared)
        rows.append((i, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in span_dedup.op9_substring_dedup(spark, str(tmp_path)).collect()}
    expected = brute_tails(rows)
    assert got[2]["n_removed"] == 6 and got[2]["text"] == rows[1][1][len(run) + 1 :]
    for i, text in rows:
        assert got[i]["n_removed"] == expected[i][0] and words(got[i]["text"]) == [w for s in expected[i][1] for w in s]
        if not expected[i][0]:
            assert got[i]["text"] == text


# decontamination


@pytest.fixture(scope="module")
def items():
    r = random.Random(7)
    word = lambda: r.choice(["the", "of", "and", "in"]) if r.random() < 0.4 else f"v{r.randint(0, 150)}"
    return [(i, ". ".join(" ".join(word() for _ in range(r.randint(4, 12))) for _ in range(r.randint(1, 4))) + ".") for i in range(150)]


def test_wand_retrieves_all_above_the_threshold(items):
    index = decontaminate.Index(items, blocks=16)
    r = random.Random(8)
    n_found = 0
    for _ in range(400):
        bag = set(r.sample(range(len(index.terms)), r.randint(1, 60)))
        if r.random() < 0.5:
            h = np.concatenate(index.parts[r.randrange(len(items))])
            bag |= set(index.lookup(h).tolist())
        scores = collections.defaultdict(float)
        for t in bag:
            for i, x in zip(index.postings[t].items, index.postings[t].impacts, strict=True):
                scores[i] += x
        for threshold in (0.2, 0.6):
            expected = {i: s for i, s in scores.items() if s >= threshold}
            got = dict(index.search(np.array(sorted(bag)), threshold))
            assert got.keys() == expected.keys() and all(math.isclose(got[i], s) for i, s in expected.items())
            n_found += len(got)
    assert n_found > 200


def test_the_number_of_parts_changes_no_hit(spark, items):
    r = random.Random(13)
    filler = lambda: " ".join(r.choice("ga be ru lo mi ta".split()) + str(r.randint(0, 300)) for _ in range(r.randint(0, 120)))
    docs = [(i, filler() + " " + r.choice(items)[1] + " " + filler()) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0], (10_000, None), (10_001, " ")], "item_id long, text string")
    total = sum(len(words(t)) for _, t in items)
    row = lambda x: (x["doc_id"], x["item_id"], x["n_passages"], round(x["score"], 12), x["question_overlap"], x["answer_overlap"])
    one, many = (sorted(row(x) for x in decontaminate.hits(df, bench, part_words=n).collect()) for n in (10 * total, total // 4))
    assert one == many and len(one) >= 60
    kept = [sorted(x["doc_id"] for x in decontaminate.decontaminate(df, bench, part_words=n).collect()) for n in (10 * total, total // 4)]
    assert kept[0] == kept[1]


def test_hits_equal_brute_force(spark, items):
    r = random.Random(9)
    docs = []
    for i in range(200):
        text = [f"z{r.randint(0, 500)}" if r.random() < 0.5 else f"v{r.randint(0, 150)}" for _ in range(r.randint(0, 300))]
        if r.random() < 0.4:
            at = r.randint(0, len(text))
            item = r.choice(items)[1].split(" ")
            text[at:at] = item if r.random() < 0.6 else item[: len(item) // 2]
        docs.append((i, " ".join(text)))
    plain = lambda t: re.findall(r"[a-z0-9]+", lower(t))
    expected = set()
    for i, t in docs:
        w = plain(t)
        joined = " " + " ".join(w) + " "
        expected |= {(i, j) for j, x in items if f" {' '.join(plain(x))} " in joined}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x"), (900, None), (901, "")], "item_id long, text string")
    found = decontaminate.hits(df, bench).collect()
    got = {(x["doc_id"], x["item_id"]) for x in found}
    assert expected <= got and len(expected) > 20
    for i, j in got - expected:  # then nearly all of it
        q = set(zip(*(plain(dict(items)[j])[k:] for k in range(5)), strict=False)) or {tuple(plain(dict(items)[j]))}
        have = set(zip(*(plain(docs[i][1])[k:] for k in range(5)), strict=False))
        assert len(q & have) >= 0.6 * len(q)
    clean = {x["doc_id"] for x in decontaminate.decontaminate(df, bench).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def test_decontamination_of_odd_rows(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "no id at all, but some words in it"), (2, "no id at all, but some words in it")], "item_id long, text string")
    for limit in (1 << 26, 10):
        monkeypatch.setattr(decontaminate, "PART_WORDS", limit)
        kept = sorted(str(r["doc_id"]) for r in decontaminate.decontaminate(odd, bench).collect())
        assert kept == sorted(map(str, (1, 2, 3, 4, 7, 8)))
        assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()
