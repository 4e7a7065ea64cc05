"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns. They are cut into slices of a few MB, so that the numpy temporaries stay
small whatever the batch size; words are found and hashed over the slice's UTF-8 bytes without a Python loop.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; A-Z is lower-cased and no other letter. Null texts have no words.
Hashes are 64 bits wide: two different words or shingles are taken as equal only if such hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for operators that compare letters and digits only.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S27, _S30, _S31 = (np.uint64(x) for x in (27, 30, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection of 64-bit words."""
    x = (x ^ (x >> _S30)) * _C2
    x = (x ^ (x >> _S27)) * _C3
    return x ^ (x >> _S31)


def fold(hashes: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash for each row of a sequence of hashes; the order counts."""
    out = np.full(len(hashes[0]), mix(np.array([seed + len(hashes)], np.uint64))[0], np.uint64)
    for h in hashes:
        out = mix((out + _C1) ^ h)
    return out


@dataclass
class Words:
    """Words of a slice of texts: ``buf`` holds the bytes, ``first[i]:first[i + 1]`` are the words of text i."""

    raw: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end)

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of k words; a text of fewer words, but some, has its whole sequence."""
        h = self.hashes() if hashes is None else hashes
        doc, n = self.doc, np.diff(self.first)
        if len(h) >= k:
            whole = doc[: len(h) - k + 1] == doc[k - 1 :]
            at = np.flatnonzero(whole)
            docs, out = doc[at], fold([h[at + j] for j in range(k)])
        else:
            docs, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra = []
            for i in short:
                extra.append(fold([h[j : j + 1] for j in range(self.first[i], self.first[i + 1])])[0])
            docs, out = np.concatenate([docs, short]), np.concatenate([out, np.array(extra, np.uint64)])
        return docs, out

    def sets(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of each text, sorted: ``hash[first[i]:first[i + 1]]`` for text i."""
        docs, out = self.shingles(k, hashes)
        order = np.lexsort((out, docs))
        docs, out = docs[order], out[order]
        keep = np.ones(len(out), bool)
        keep[1:] = (docs[1:] != docs[:-1]) | (out[1:] != out[:-1])
        docs, out = docs[keep], out[keep]
        return np.searchsorted(docs, np.arange(len(self.first))), out


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``buf`` must have 8 spare bytes at its end."""
    length = end - start
    view = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), shape=(len(buf) - 7,), strides=(1,))
    out = mix(length.astype(np.uint64) * _C1)
    at, left, live = start, length, None
    for _ in range(LONG_WORD // 8):
        x = view[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            out = mix((out + _C1) ^ x)
            live = np.flatnonzero(left > 8)
        else:
            out[live] = mix((out[live] + _C1) ^ x)
            live = live[left > 8]
        if not len(live):
            break
        step = left > 8
        at, left = at[step] + 8, left[step] - 8
    else:
        import xxhash

        for i in live:  # beyond LONG_WORD bytes
            out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes()))
    return out


def words(texts: list[bytes], space: np.ndarray = _SPACE) -> Words:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    raw = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n = int(offsets[-1])
    buf = _LOWER[raw]
    solid = ~space[buf[:n]]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[:-1][offsets[:-1] < n]
    begins[inner] = solid[inner]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(raw, buf, offsets, start, end, np.searchsorted(start, offsets))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts together have about ``most`` bytes, a single longer text by itself."""
    step = max(1, min(2048, batch.num_rows))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        texts = utf8(part.column(text))
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield part.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield part.slice(begin), texts[begin:]


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values, pa.int64())
