"""A small causal self-attention model in numpy: forward and backward passes, training, batched window scoring.

The vocabulary is split into classes: P(id | before) = P(class | before) * P(id | class). The first factor is a one-layer attention
model, which predicts the most frequent classes outright and the others in two steps, a group of classes and the class in it; the second comes from the ids' counts after the id before, backed off to their counts alone. Frequent ids have a class and an input symbol of their own, the others share those of
the class that k-means puts them in by the ids they follow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 48, 36
DIM, HIDDEN = 24, 48
CLASSES, OWN_CLASSES, SYMBOLS = 256, 160, 2048
#: The classes from TAIL[0] on are predicted in two steps, their group and then the class in it; groups begin at TAIL. Columns of U and b: the groups, then the classes.
TAIL = (32, 72, 112, 160, 208)
GROUPS = len(TAIL)
TOP = GROUPS + TAIL[0]
SPANS = [(a + GROUPS, b + GROUPS) for a, b in zip(TAIL, (*TAIL[1:], CLASSES), strict=True)]
CHUNK, BLOCK = 128, 256
ROWS, COLUMNS, BACKOFF = 512, 8192, 30.0  # ids with counts of their own as the id before, and as the id; weight of the counts alone


class Contexts:
    """What the ids that share classes stand beside: how often each of 256 frequent ids comes before it and after it."""

    def __init__(self, count: np.ndarray):
        n_ids = len(count)
        self.order = np.lexsort((np.arange(n_ids), -count))
        rest = self.order[OWN_CLASSES : OWN_CLASSES + 8192]
        self.rest, self.heads = rest[count[rest] > 1], self.order[:256]
        self.row, self.column = np.full(n_ids, -1, np.int32), np.full(n_ids, -1, np.int32)
        self.row[self.rest], self.column[self.heads] = np.arange(len(self.rest)), np.arange(len(self.heads))
        self.size = len(self.rest) * 2 * len(self.heads)

    def codes(self, stream: np.ndarray) -> np.ndarray:
        """A number below ``size`` for each neighbour of each such id."""
        row, column, out = self.row[stream], self.column[stream], []
        for r, c, shift in ((row[1:], column[:-1], 0), (row[:-1], column[1:], len(self.heads))):
            ok = np.flatnonzero((r >= 0) & (c >= 0))
            out.append(r[ok].astype(np.int64) * (2 * len(self.heads)) + c[ok] + shift)
        return np.concatenate(out)


def classify(stream: np.ndarray, n_ids: int, rng: np.random.Generator, count: np.ndarray, cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class, input symbol) of each id, from the counts of ids and of their contexts, those of the stream unless given."""
    at = Contexts(count)
    order, rest = at.order, at.rest
    cls = np.full(n_ids, CLASSES - 1)
    own = order[:OWN_CLASSES]
    cls[own] = np.arange(OWN_CLASSES)
    # The rest by what they follow and by whether they begin a word is left to the counts of the ids before them.
    groups = CLASSES - OWN_CLASSES
    if len(rest) > groups:
        table = (np.bincount(at.codes(stream), minlength=at.size) if cells is None else cells).reshape(len(rest), -1).astype(np.float32)
        table = np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1))
        centre = table[rng.choice(len(rest), groups, replace=False)]
        for _ in range(12):
            near = (table @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            for g in range(groups):
                if (near == g).any():
                    centre[g] = table[near == g].mean(0)
        cls[rest] = OWN_CLASSES + near
    symbol = SYMBOLS + cls
    symbol[order[:SYMBOLS]] = np.arange(min(SYMBOLS, n_ids))
    return cls, symbol


@dataclass
class Model:
    cls: np.ndarray  # of each id
    symbol: np.ndarray
    p: dict[str, np.ndarray]
    order: np.ndarray  # ids by frequency in the sample
    log_in: np.ndarray | None = None  # natural log of P(id | class)
    after: np.ndarray | None = None  # what log P(id | class, id before) has more, by row and column

    def __post_init__(self) -> None:
        self.row, self.column = ROWS + self.cls, COLUMNS + self.cls
        self.row[self.order[:ROWS]] = np.arange(min(ROWS, len(self.order)))
        self.column[self.order[:COLUMNS]] = np.arange(min(COLUMNS, len(self.order)))

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the (id before, id) pairs of a stream; fewer than N_PAIRS."""
        return self.row[ids[:-1]] * (COLUMNS + CLASSES) + self.column[ids[1:]]

    def set_counts(self, counts: np.ndarray, pairs: np.ndarray | None = None) -> None:
        """P(id | class) by counts, one more for each id, and P(id | class, id before) by the counts of pairs."""
        total = np.bincount(self.cls, counts + 1.0, minlength=CLASSES)
        self.log_in = np.log((counts + 1.0) / total[self.cls]).astype(np.float32)
        width = COLUMNS + CLASSES
        self.after = np.zeros((ROWS + CLASSES, width), np.float32)
        if pairs is None:
            return
        seen = pairs.reshape(ROWS + CLASSES, width).astype(float)
        seen[:, COLUMNS:] = 0  # ids without a column of their own are backed off
        own = self.order[:COLUMNS]
        cls = np.concatenate([self.cls[own], np.zeros(COLUMNS - len(own), np.int64), np.arange(CLASSES)])
        p = np.concatenate([np.exp(self.log_in[own].astype(float)), np.ones(COLUMNS - len(own) + CLASSES)])
        for r in range(len(seen)):
            of_class = np.bincount(cls, seen[r], minlength=CLASSES)[cls]
            self.after[r] = np.log((seen[r] / p + BACKOFF) / (of_class + BACKOFF))

    def class_log(self, symbols: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """What ``Forward`` gives for one chunk."""
        return Forward(self.p)(symbols, targets)

    def score(self, texts: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log-probability of each text's ids and the end id after them; each is scored once.

        Windows overlap by WINDOW - STRIDE positions; before a text stand so many end ids."""
        n = np.array([len(t) + 1 for t in texts])
        windows = -(-n // STRIDE)
        lead = WINDOW - STRIDE
        size = lead + windows * STRIDE
        base = np.concatenate([[0], np.cumsum(size)])
        ids = np.full(int(base[-1]) + 1, end, np.int64)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        inner = np.cumsum(n - 1) - (n - 1)
        # Inputs: lead ends, then the end that starts the text, then the text; the target of a position is the next input.
        ids[np.repeat(base[:-1] + lead + 1 - inner, n - 1) + np.arange(len(flat))] = flat
        # A text of a whole number of strides has its end id at the next text's first lead, which is an end id too.
        symbols, cls, row, column = self.symbol[ids], self.cls[ids], self.row[ids] * (COLUMNS + CLASSES), self.column[ids]
        after = self.after.ravel()
        first = np.repeat(base[:-1] - STRIDE * (np.cumsum(windows) - windows), windows) + STRIDE * np.arange(int(windows.sum()))
        owner = np.repeat(np.arange(len(texts)), windows)
        left = np.repeat(n, windows) - (first - base[owner])  # positions to score from each window on
        # All chunks are full, and windows are summed in one go: products and sums may round otherwise in other shapes, and equal texts have equal scores.
        spare = -len(first) % CHUNK
        first, owner, left = np.append(first, np.zeros(spare, np.int64)), np.append(owner, np.zeros(spare, np.int64)), np.append(left, np.zeros(spare, np.int64))
        out = np.zeros(len(first))
        inputs, scored, class_log = np.arange(WINDOW), np.arange(STRIDE), Forward(self.p)
        for c in range(0, len(first), CHUNK):
            f = first[c : c + CHUNK]
            target = f[:, None] + lead + 1 + scored
            value = class_log(symbols[f[:, None] + inputs], cls[target]) + self.log_in[ids[target]] + after.take(row[target - 1] + column[target])
            value = np.where(scored < left[c : c + CHUNK, None], value, 0)
            out[c : c + CHUNK] = value.sum(1, dtype=np.float64)
        return np.bincount(owner, out, minlength=len(texts))


class Forward:
    """log P(class) of targets (windows, STRIDE) after symbols (windows, WINDOW), for the last STRIDE positions of at most CHUNK windows.

    Arrays are made once and written again for each chunk; the biases are a row of the weights, met by a last column of ones. Exponentials are taken without a
    row's maximum, for speed; rows where they overflow or vanish are done again with it. Positions of a group go in blocks of one size, the last filled up, for a product may round otherwise in another shape."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, of = p, _joined(p)
        # What a symbol and its place give for queries and values is added up, as they are themselves.
        self.q, self.v = ((p["E"] @ w, p["P"] @ w) for w in of)
        self.w1, self.u = np.vstack([p["W1"], p["b1"]]), np.vstack([p["U"], p["b"]])
        self.top, self.groups = np.ascontiguousarray(self.u[:, :TOP]), [np.ascontiguousarray(self.u[:, a:b]) for a, b in SPANS]
        room = lambda *shape: np.empty(shape, np.float32)
        self.x, self.v_of, self.a = room(CHUNK, WINDOW, DIM), room(CHUNK, WINDOW, DIM), room(CHUNK, STRIDE, WINDOW)
        self.h, self.turned, self.mid, self.z = np.ones((CHUNK * STRIDE, DIM + 1), np.float32), room(CHUNK * STRIDE, DIM), room(CHUNK * STRIDE, len(p["b1"])), room(CHUNK * STRIDE, TOP)
        self.block, self.inner = np.zeros((BLOCK, DIM + 1), np.float32), [room(BLOCK, b - a) for a, b in SPANS]
        self.rows, self.column = np.arange(CHUNK * STRIDE), np.zeros(BLOCK, np.int64)

    def __call__(self, symbols: np.ndarray, targets: np.ndarray) -> np.ndarray:
        p, n = self.p, len(symbols)
        m = n * STRIDE
        x = p["E"].take(symbols, axis=0, out=self.x[:n], mode="clip")
        x += p["P"]
        v = self.v[0].take(symbols, axis=0, out=self.v_of[:n], mode="clip")
        v += self.v[1]
        biased = self.h[:m]
        h, turned = biased[:, :DIM], self.turned[:m]
        q = self.q[0].take(symbols[:, WINDOW - STRIDE :], axis=0, out=turned.reshape(n, STRIDE, DIM), mode="clip")
        q += self.q[1][WINDOW - STRIDE :]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            a = np.matmul(q, x.transpose(0, 2, 1), out=self.a[:n])
            np.exp(a, out=a)
            a *= _MASK[WINDOW - STRIDE :]
            total = a.reshape(-1, WINDOW) @ _ONES[:WINDOW]
            for i in np.flatnonzero(~((total > 0) & (total < np.inf))):
                w, at = divmod(i, STRIDE)
                s = np.where(_MASK[WINDOW - STRIDE + at] > 0, x[w] @ q[w, at], -np.inf)
                a[w, at] = np.exp(s - s.max())
                total[i] = a[w, at].sum()
            mixed = np.matmul(a, v, out=turned.reshape(n, STRIDE, DIM)).reshape(m, DIM)
            mixed /= total[:, None]
            np.add(x[:, WINDOW - STRIDE :], mixed.reshape(n, STRIDE, DIM), out=biased.reshape(n, STRIDE, DIM + 1)[:, :, :DIM])
            mid = np.matmul(biased, self.w1, out=self.mid[:m])
            h += np.matmul(np.maximum(mid, 0, out=mid), p["W2"], out=turned)
            targets = targets.ravel()
            out = _log_softmax(biased, self.top, _TOP_OF[targets], self.rows[:m], self.z[:m])
            group = _GROUP_OF[targets]
            for g, u in enumerate(self.groups):
                at = np.flatnonzero(group == g)
                where = targets[at] - (SPANS[g][0] - GROUPS)
                for i in range(0, len(at), BLOCK):
                    k = at[i : i + BLOCK]
                    self.block[: len(k)] = biased[k]
                    self.column[: len(k)] = where[i : i + BLOCK]
                    self.column[len(k) :] = 0
                    out[k] += _log_softmax(self.block, u, self.column, self.rows[:BLOCK], self.inner[g])[: len(k)]
        return out.reshape(-1, STRIDE)


def _log_softmax(h: np.ndarray, u: np.ndarray, at: np.ndarray, rows: np.ndarray, z: np.ndarray) -> np.ndarray:
    """log P of column ``at`` of each row of the softmax of h @ u; ``z`` is written over."""
    np.matmul(h, u, out=z)
    reached = z[rows, at]
    total = np.exp(z, out=z) @ _ONES[: u.shape[1]]
    out = reached - np.log(total)
    if not np.isfinite(out.sum()):
        odd = np.flatnonzero(~((total > 0) & (total < np.inf)))
        z = h[odd] @ u
        top = z.max(1)
        out[odd] = reached[odd] - top - np.log(np.exp(z - top[:, None]).sum(1))
    return out


N_PAIRS = (ROWS + CLASSES) * (COLUMNS + CLASSES)
_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_CELLS = np.arange((SYMBOLS + CLASSES) * DIM).reshape(-1, DIM)
_ONES = np.ones(max(WINDOW, CLASSES + GROUPS), np.float32)
#: Of each class: its column in the first softmax, or that of its group, and the number of its group, GROUPS if it has none.
_GROUP_OF = np.digitize(np.arange(CLASSES), TAIL[1:]).astype(np.int8)
_GROUP_OF[: TAIL[0]] = GROUPS
_TOP_OF = np.where(_GROUP_OF < GROUPS, _GROUP_OF, np.arange(CLASSES) + GROUPS)


def _joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The products of Q and K, scaled, and of V and O: scores and what is mixed come from the inputs by one product each."""
    return (p["Q"] @ p["K"].T) * p["Q"].dtype.type(1 / np.sqrt(DIM)), p["V"] @ p["O"]


class Room:
    """Arrays that are made once and written again by each step."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int, dtype: np.dtype | None = None) -> np.ndarray:
        have = self.held.get(name)
        if have is None or have.shape[1:] != shape[1:] or have.shape[0] < shape[0]:
            have = self.held[name] = np.ones(shape, dtype or self.dtype)
        return have[: shape[0]]


def _attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, a: np.ndarray, out: np.ndarray) -> None:
    """The weights of attention and what they mix, both before they are divided by the last column, the weights' sums; a row's maximum is taken off only where exponentials overflow or vanish without."""
    w = a.shape[1]
    np.matmul(q, k.transpose(0, 2, 1), out=a)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        a *= _MASK[:w, :w]
        np.matmul(a, v, out=out)
        total = out[:, :, -1]
        if not (total.min() > 1e-30 and total.max() < 1e30):
            np.matmul(q, k.transpose(0, 2, 1), out=a)
            a[:, _MASK[:w, :w] == 0] = -np.inf
            a -= a.max(2, keepdims=True)
            np.exp(a, out=a)
            np.matmul(a, v, out=out)


def _softmax(h: np.ndarray, u: np.ndarray, targets: np.ndarray, m: int, dh: np.ndarray, g: np.ndarray, room: Room, name: str) -> float:
    """The sum of -log P of the targets, columns of the softmax of h @ u. ``dh`` and ``g`` get the gradients of h (without its ones) and u of that sum over ``m``.

    What a row is divided by goes to the narrow arrays beside it, not to all its columns."""
    e = np.matmul(h, u, out=room(name, len(h), u.shape[1]))
    at = np.arange(0, e.size, e.shape[1]) + targets
    cells = e.reshape(-1)
    reached = cells[at]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], e.dtype)
        if not (total.min() > 1e-30 and total.max() < 1e30):
            np.matmul(h, u, out=e)
            top = e.max(1)
            e -= top[:, None]
            reached -= top
            total = np.exp(e, out=e).sum(1)
    cells[at] -= total
    by = 1 / (total * e.dtype.type(m))
    # The row of the biases has a product of its own: 24 rows are multiplied faster than 25.
    g[:-1] = np.multiply(h[:, :-1], by[:, None], out=room(name + " h", len(h), DIM)).T @ e
    g[-1] = by @ e
    np.matmul(e, u[:-1].T, out=dh)
    dh *= by[:, None]
    return float((np.log(total) - reached).sum())


def _loss(p: dict[str, np.ndarray], symbols: np.ndarray, targets: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the classes after every position of the windows, and its gradients.

    Biases are a row of their weights, met by a last column of ones."""
    n, w = symbols.shape
    m, d = n * w, DIM
    room = room or Room(p["E"].dtype)
    qv_of = np.concatenate(_joined(p), 1)
    w1, u = np.vstack([p["W1"], p["b1"]]), np.vstack([p["U"], p["b"]])
    x = p["E"].take(symbols.ravel(), axis=0, out=room("x", m, d), mode="clip")
    x.reshape(n, w, d)[...] += p["P"][:w]
    x3 = x.reshape(n, w, d)
    qv = room("qv", m, 2 * d + 1)  # with a column of ones
    np.matmul(x, qv_of, out=qv[:, : 2 * d])
    qv = qv.reshape(n, w, 2 * d + 1)
    q, v = qv[:, :, :d], qv[:, :, d:]
    a, mixed = room("a", n, w, w), room("mixed", n, w, d + 1)
    _attend(q, x3, v, a, mixed)
    mixed = mixed.reshape(m, d + 1)
    by = 1 / mixed[:, d:]
    mixed = np.multiply(mixed[:, :d], by, out=room("part of inputs", m, d))
    h1, h2 = room("h1", m, d + 1), room("h2", m, d + 1)  # with a column of ones
    part = room("part", m, d)
    np.add(x, mixed, out=h1[:, :d])
    r = np.matmul(h1, w1, out=room("r", m, w1.shape[1]))
    np.maximum(r, 0, out=r)
    np.add(h1[:, :d], np.matmul(r, p["W2"], out=part), out=h2[:, :d])
    targets, dh, g_u, g = targets.ravel(), room("dh", m, d), np.zeros_like(u), {}
    loss = _softmax(h2, u[:, :TOP], _TOP_OF[targets], m, dh, g_u[:, :TOP], room, "top")
    group = _GROUP_OF[targets]
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS + 1)[:GROUPS])
    order = order[: ends[-1]]
    inner, d_inner, where = h2.take(order, axis=0, out=room("inner", len(order), d + 1), mode="clip"), room("d inner", len(order), d), targets[order]
    for (lo, hi), start, end in zip(SPANS, [0, *ends], ends, strict=False):
        if end > start:
            loss += _softmax(inner[start:end], u[:, lo:hi], where[start:end] - (lo - GROUPS), m, d_inner[start:end], g_u[:, lo:hi], room, f"inner {lo}")
    dh[order] += d_inner
    g["U"], g["b"] = g_u[:-1], g_u[-1]
    g["W2"] = r.T @ dh
    dr = np.matmul(dh, p["W2"].T, out=room("dr", m, w1.shape[1]))
    dr *= r > 0
    g_1 = h1.T @ dr
    g["W1"], g["b1"] = g_1[:-1], g_1[-1]
    dh += np.matmul(dr, p["W1"].T, out=part)
    # What a row of da less the sum of its a * da is comes from one product, by the column of ones in v.
    dm1, dqv = room("dm", m, d + 1), room("dqv", n, w, 2 * d)
    dm = np.multiply(dh, by, out=dm1[:, :d])
    np.negative(np.einsum("ij,ij->i", dm, mixed), out=dm1[:, d])
    dm3 = dm1.reshape(n, w, d + 1)
    np.matmul(a.transpose(0, 2, 1), dm3[:, :, :d], out=dqv[:, :, d:])
    da = np.matmul(dm3, v.transpose(0, 2, 1), out=room("da", n, w, w))
    da *= a
    np.matmul(da, x3, out=dqv[:, :, :d])
    dh += np.matmul(da.transpose(0, 2, 1), q, out=part.reshape(n, w, d)).reshape(m, d)
    g_qv = x.T @ dqv.reshape(m, 2 * d)
    dh += np.matmul(dqv.reshape(m, 2 * d), qv_of.T, out=part)
    scale, g_qk, g_vo = p["Q"].dtype.type(1 / np.sqrt(d)), g_qv[:, :d], g_qv[:, d:]
    g["Q"], g["K"], g["V"], g["O"] = g_qk @ p["K"] * scale, g_qk.T @ p["Q"] * scale, g_vo @ p["O"].T, p["V"].T @ g_vo
    g["P"] = np.zeros_like(p["P"])
    g["P"][:w] = dh.reshape(n, w, d).sum(0)
    cells = _CELLS.take(symbols.ravel(), axis=0, out=room("cells", m, d, dtype=np.int64), mode="clip")
    g["E"] = np.bincount(cells.ravel(), dh.ravel(), minlength=p["E"].size).reshape(p["E"].shape)
    return loss / m, g


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class Learner:
    """Adam steps on batches of windows of a stream of ids."""

    def __init__(self, model: Model, rate: float, batch: int = 48, seed: int = 1):
        self.model, self.rate, self.batch, self.rng = model, rate, batch, np.random.default_rng(seed)
        # The weights lie in one array, and so do the gradients, their means and those of their squares.
        self.now = flat(model.p)
        self.slope, self.first, self.second, self.part = (np.zeros_like(self.now) for _ in range(4))
        self.room = Room(self.now.dtype)
        self.into, at = {}, 0
        model.p = dict(model.p)
        for k in sorted(model.p):
            shape, size = model.p[k].shape, model.p[k].size
            model.p[k], self.into[k] = self.now[at : at + size].reshape(shape), self.slope[at : at + size].reshape(shape)
            at += size
        self.steps = self.windows = 0

    def step(self, symbols: np.ndarray, classes: np.ndarray, rate: float) -> float:
        loss, g = _loss(self.model.p, symbols, classes, self.room)
        for k, d in g.items():
            self.into[k][...] = d
        self.steps += 1
        t, d, part = self.steps, self.slope, self.part
        # The means are kept 10 and 100 times as large, which the rate and the 1e-8 make good.
        self.first *= 0.9
        self.first += d
        self.second *= 0.99
        self.second += np.multiply(d, d, out=part)
        np.sqrt(self.second, out=part)
        far = float(np.sqrt(100 * (1 - 0.99**t)))
        part += 1e-8 * far
        np.divide(self.first, part, out=part)
        part *= 0.1 * rate * far / (1 - 0.9**t)
        self.now -= part
        self.windows += len(symbols)
        return loss

    def read(self, stream: np.ndarray, share: int = 1) -> None:
        """The stream's windows in random order, one in ``share`` of them; with 1, each id is predicted once. A last window that the stream doesn't fill begins earlier."""
        stream = np.concatenate([np.full(1 + max(0, WINDOW - len(stream)), stream[-1]), stream])  # an end
        last = len(stream) - 1 - WINDOW
        starts = self.rng.permutation(np.append(np.arange(0, last, WINDOW), last))
        starts = starts[: max(1, len(starts) // share)]
        symbol, cls = self.model.symbol[stream[:-1]], self.model.cls[stream[1:]]
        for a in range(0, len(starts), self.batch):
            at = starts[a : a + self.batch, None] + np.arange(WINDOW)
            self.step(symbol[at], cls[at], self.rate * min(1, (self.steps + 1) / 20) * len(at) / self.batch)


def train(texts: list[np.ndarray], n_ids: int, end: int, steps: int = 600, batch: int = 48, seed: int = 1, counts: np.ndarray | None = None, cells: np.ndarray | None = None) -> Model:
    """Fits the attention model to sample texts by Adam; deterministic for a seed. ``counts`` of ids choose those with classes and symbols of their own, ``cells`` of their contexts the classes of the others; both are the sample's unless given."""
    rng = np.random.default_rng(seed)
    lead = np.full(WINDOW - STRIDE + 1, end)
    stream = np.concatenate([np.concatenate([lead, t]) for t in texts] + [np.full(WINDOW + 1, end)]).astype(np.int64)
    counts = np.bincount(stream, minlength=n_ids) if counts is None else counts
    cls, symbol = classify(stream, n_ids, rng, counts, cells)
    normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"E": normal(SYMBOLS + CLASSES, DIM, s=0.3), "P": normal(WINDOW, DIM, s=0.05), "W1": normal(DIM, HIDDEN, s=0.25), "b1": np.zeros(HIDDEN, np.float32), "W2": normal(HIDDEN, DIM, s=0.1), "U": normal(DIM, GROUPS + CLASSES, s=0.2)}
    p |= {k: normal(DIM, DIM, s=0.25) for k in "QKVO"}
    share = np.bincount(cls[stream], minlength=CLASSES) + 1.0
    p["b"] = np.log(np.append(np.bincount(_GROUP_OF, share)[:GROUPS], share) / share.sum()).astype(np.float32)
    model = Model(cls, symbol, p, np.lexsort((np.arange(n_ids), -counts)))
    if len(stream) <= WINDOW + 1:
        return model
    learner = Learner(model, 0.01, batch)
    for t in range(1, steps + 1):
        at = rng.integers(0, len(stream) - WINDOW, batch)[:, None] + np.arange(WINDOW)
        learner.step(symbol[stream[at]], cls[stream[at + 1]], 0.01 * min(1, t / 50) * (1 - 0.9 * t / steps))
    return model
