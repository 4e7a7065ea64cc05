import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard, textkit


def brute(rows, k, percent):
    """Component by union of all linked pairs."""
    docs = {}
    for i, t in rows:
        if i is not None:
            docs[i] = set(textkit.words([(t or "").encode()]).sets(k)[1].tolist())
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = docs[a], docs[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(docs[i]), find(i)) for i in ids}


def crafted(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    common = [word() for _ in range(60)]
    rows, i = [], 0
    base = [word() for _ in range(150)]
    for _ in range(60):  # near copies at all distances
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            t[r.randrange(len(t))] = word()
        rows.append((i := i + 1, " ".join(t[: r.randint(100, 150)] if r.random() < 0.3 else t)))
    for _ in range(60):  # a common passage in otherwise different texts
        rows.append((i := i + 1, " ".join([word() for _ in range(r.randint(3, 60))] + common)))
    rows += [(i + j, rows[0][1]) for j in range(1, 6)]
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_classes_equal_brute_force(spark, seed, k, percent):
    rows = crafted(seed)
    got = jaccard.linked_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, k, percent)


def test_salted_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    rows = crafted(4)
    got = jaccard.linked_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)


def test_odd_rows(spark, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_classes(odd.withColumnRenamed("lang", "rep"), 4, 85).collect()}
    expected = brute([(r["doc_id"], r["text"]) for r in odd.collect()], 4, 85)
    assert got == expected and got[6][1] == 5 and got[1] == (0, 1) and got[4] == (1, 4)


def test_empty_table(none):
    assert jaccard.linked_classes(none).collect() == []


def test_buckets_in_batches_of_any_size():
    """All pairs of a bucket that could link are candidates, or in one group through their bucket's first document."""
    r = random.Random(5)
    rows = []
    for token in range(40):
        members = r.sample(range(200), r.choice([1, 2, 5, 9, 14, 30]))
        rows += [(token, -1, 2 * (10 + d % 7) + r.randint(0, 1), d) for d in members]
    rows.sort()
    names = ["token", "salt", "size", "doc"]

    def run(step):
        batches = [pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in rows[a : a + step]], pa.int64()) for i, n in enumerate(names)}) for a in range(0, len(rows), step)]
        return {tuple(x.values()) for b in jaccard._bucket_pairs(80)(iter(batches)) for x in b.to_pylist()}

    for step in (1, 3, 7, 1000):
        found = run(step)
        candidates = {(a, b) for a, b, kind in found if kind < 2}
        near = {}
        for a, b, kind in found:
            if kind in (1, 2):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)

        def group(x, near=near):
            seen, todo = {x}, [x]
            while todo:
                for y in near.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        for token in range(40):
            bucket = [x for x in rows if x[0] == token]
            for i, x in enumerate(bucket):
                for y in bucket[i + 1 :]:
                    if x[2] % 2 == 0 and 100 * (x[2] // 2) >= 80 * (y[2] // 2):
                        pair = (min(x[3], y[3]), max(x[3], y[3]))
                        assert pair in candidates or y[3] in group(x[3])


def test_block_comparison_equals_brute_force():
    r = random.Random(6)
    level = np.zeros(jaccard.SKETCH, np.uint16)
    sets = [np.array(sorted({r.randrange(40) for _ in range(r.randint(5, 30))}), np.uint64) for _ in range(60)]
    for split in (None, 25):
        a, b = (sets, None) if split is None else (sets[:split], sets[split:])
        links = jaccard.compare_block(70, level, a, b, np.arange(60))
        root = list(range(60))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in links:
            root[find(i)] = find(j)
        for i in range(60 if split is None else split):
            for j in range(i + 1 if split is None else split, 60):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(x & y) >= 70 * len(x | y):
                    assert find(i) == find(j)
        assert all(100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 70 * len(set(sets[i].tolist()) | set(sets[j].tolist())) for i, j in links)


def test_a_larger_corpus_changes_no_order():
    """What rare tokens add to every counter, whatever the corpus, neither reorders the common ones nor makes any of them hot."""
    r = np.random.default_rng(3)
    counts = r.integers(0, 3, jaccard.SKETCH)
    counts[r.integers(0, jaccard.SKETCH, 500)] += r.integers(100, 1_000_000, 500)
    assert (jaccard.levels(counts) == jaccard.levels(counts + 200_000)).all()
    assert (jaccard.excess(counts) > jaccard.HOT).sum() == (jaccard.excess(counts + 200_000) > jaccard.HOT).sum() > 0


@pytest.mark.parametrize(("block", "broadcast"), [(2_000_000, 10), (150, 10), (150, 0)])
def test_a_saturated_sketch_and_small_blocks_lose_nothing(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(jaccard, "SKETCH", 1 << 8)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", broadcast)
    r = random.Random(17)
    line = " ".join(f"l{i}" for i in range(30))
    rows = []
    for i in range(90):  # all hold one passage, which makes most of some of them
        text = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([3, 5, 8, 60]))]
        rows.append((i, " ".join(text) + " " + line if i % 3 else " ".join(text[:2]) + " " + line))
    rows += [(100 + i, t + " x") for i, t in rows[:20]]
    got = jaccard.linked_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute(rows, 4, 85)
