import random
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import textkit as K


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words_and_hashes_follow_the_texts():
    r = random.Random(1)
    texts = ["", "a", " a", "É é É", "x" * 700 + " " + "x" * 701, " "] + ["".join(r.choice("abAB \n\té漢") for _ in range(r.randint(0, 40))) for _ in range(200)]
    w = K.words([t.encode() for t in texts])
    got = [[bytes(w.buf[w.start[j] : w.end[j]]).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [brute(t) for t in texts]
    h, seen = w.hashes(), {}
    for word, x in zip([y for g in got for y in g], h, strict=True):
        assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    texts = ["a b c d e", "a b", "", "a b c a b c a b c"]
    first, h = K.words([t.encode() for t in texts]).sets(3)
    assert np.diff(first).tolist() == [3, 1, 0, 3]
    alone = [K.words([t.encode()]).sets(3)[1].tolist() for t in texts]
    assert [h[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == alone


def test_slices_keep_order_and_bounds():
    texts = [None, "a" * 10, "b" * 100, "", "c" * 5] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    ids, got = [], []
    for part, data in K.slices(batch, most=50):
        assert len(data) == 1 or sum(map(len, data)) <= 50
        ids += part.column("doc_id").to_pylist()
        got += data
    assert ids == list(range(len(texts))) and got == [(t or "").encode() for t in texts]
