"""Toxicity by a recurrent network over overlapping windows (dealt operator 11).

A word's input is its own embedding and the mean embedding of its letter trigrams, both hashed. A
bidirectional gated recurrent network reads windows of ``WINDOW`` words that overlap by half; attention
pools its states into one number a window. A document's score combines the greatest and the mean number
over all of its windows, so a few words in a long text count.

The network is trained in numpy, in one task, on a bounded sample of labelled documents. Labels belong to
documents: after two rounds in which windows take their document's label, only the window that the
network finds worst stands for a document. Scoring is a map over all texts; the parts of the gates that
depend on a word alone are looked up in a table.
"""

from __future__ import annotations

import io
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, ATTEND = 12, 8, 8
BUCKETS = 1 << 13
#: Bounds of the sample that the network is trained on: documents of each label, and words in all.
SAMPLE = {1: 1500, 0: 3000}
SAMPLE_WORDS = 1_500_000
#: Words of a worker's table of inputs, characters of a batch, windows that advance together.
TABLE, BATCH, TOGETHER = 100_000, 1 << 20, 1024
#: Characters of a text that are cut into words at a time.
CHUNK = 1 << 20
_SIGNS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, in small letters without ASCII signs, some at a time."""
    raw = (text or "").lower().encode("utf-8", "replace").translate(_SIGNS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its bucket, and the buckets of its trigrams, one list after the other, with their ends."""
    own = np.fromiter((zlib.crc32(w) % BUCKETS for w in vocabulary), np.int64, len(vocabulary))
    points = np.frombuffer((" " + "  ".join(w.decode("utf-8", "replace") for w in vocabulary) + " ").encode("utf-32-le"), np.uint32)
    middle = np.flatnonzero(points != 32)
    h = points[middle - 1] * np.uint32(2654435761) ^ points[middle] * np.uint32(2246822519) ^ points[middle + 1] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    return own, (h >> np.uint32(7)).astype(np.int64) % BUCKETS, np.flatnonzero(points[middle + 1] == 32) + 1


def _mean(table: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.append(0, ends[:-1])
    return np.add.reduceat(table[grams], starts, 0) / np.diff(np.append(0, ends))[:, None].astype(table.dtype)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * EMBED, HIDDEN
    shapes = {"word": (BUCKETS, EMBED), "gram": (BUCKETS, EMBED), "W": (d, 2, 3 * h), "b": (2, 3 * h), "U": (2, h, 3 * h),
              "Wa": (2 * h, ATTEND), "ba": (ATTEND,), "u": (ATTEND,), "wo": (2 * h,), "bo": (1,)}
    scale = {"word": 0.3, "gram": 0.3, "W": d**-0.5, "U": h**-0.5, "Wa": 0.3, "u": 0.3, "wo": 0.3}
    return {k: rng.normal(0, scale.get(k, 0), s).astype(np.float32) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """One number a window. gates: per word, both directions; at: the words of each window; mask: 1 for a word."""
    n, steps = at.shape
    h = HIDDEN
    both = gates.reshape(len(gates), 2, 3 * h)
    state = np.zeros((2, n, h), gates.dtype)
    states = np.empty((n, steps, 2 * h), gates.dtype)
    cache = []
    for t in range(steps):
        back = steps - 1 - t
        g = np.stack([both[at[:, t], 0], both[at[:, back], 1]])
        m = np.stack([mask[:, t], mask[:, back]])[:, :, None]
        a = state @ p["U"]
        zr = _sigmoid(g[..., :2 * h] + a[..., :2 * h])
        r = zr[..., h:]
        z = zr[..., :h] * m
        c = np.tanh(g[..., 2 * h:] + r * a[..., 2 * h:])
        if keep:
            cache.append((state, a[..., 2 * h:], zr, z, c, m))
        state = state + z * (c - state)
        states[:, t, :h] = state[0]
        states[:, back, h:] = state[1]
    s = np.tanh(states @ p["Wa"] + p["ba"])
    e = np.where(mask > 0, s @ p["u"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True))
    alpha = e / e.sum(1, keepdims=True)
    pooled = (alpha[:, None, :] @ states)[:, 0]
    return pooled @ p["wo"] + p["bo"][0], [cache, states, s, alpha, pooled]


def backward(p: dict, kept: list, d: np.ndarray, mask: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of each place's gates (n, steps, 2, 3 h), d being those of the numbers."""
    cache, states, s, alpha, pooled = kept
    n, steps, _ = states.shape
    h = HIDDEN
    g = {"wo": d @ pooled, "bo": d.sum(keepdims=True)}
    dp = d[:, None] * p["wo"]
    dstates = alpha[:, :, None] * dp[:, None, :]
    da = np.einsum("nk,ntk->nt", dp, states)
    de = alpha * (da - (alpha * da).sum(1, keepdims=True)) * (mask > 0)
    g["u"] = np.einsum("nt,nta->a", de, s)
    ds = de[:, :, None] * p["u"] * (1 - s * s)
    g["ba"] = ds.sum((0, 1))
    g["Wa"] = states.reshape(-1, 2 * h).T @ ds.reshape(-1, ATTEND)
    dstates += ds @ p["Wa"].T
    g["U"] = np.zeros_like(p["U"])
    out = np.zeros((n, steps, 2, 3 * h), states.dtype)
    dh = np.zeros((2, n, h), states.dtype)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        dh[0] += dstates[:, t, :h]
        dh[1] += dstates[:, back, h:]
        state, ac, zr, z, c, m = cache[t]
        r = zr[..., h:]
        dc = dh * z * (1 - c * c)
        dzr = np.concatenate([dh * (c - state) * m, dc * ac], -1) * zr * (1 - zr)
        dgate = np.concatenate([dzr, dc], -1)
        drec = np.concatenate([dzr, dc * r], -1)
        g["U"] += state.transpose(0, 2, 1) @ drec
        dh = dh * (1 - z) + drec @ p["U"].transpose(0, 2, 1)
        out[:, t, 0] = dgate[0]
        out[:, back, 1] = dgate[1]
    return g, out


def gates_of(p: dict, own: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    x = np.concatenate([p["word"][own], _mean(p["gram"], grams, ends)], 1)
    return x @ p["W"].reshape(2 * EMBED, -1) + p["b"].reshape(-1)


def _scatter(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by ``at``: the distinct places and their sums."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    return rows, np.add.reduceat(values[order], first, 0)


class _Adam:
    """Adam, which moves of the embeddings only the rows that a step touched."""

    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            rows = slice(None)
            if isinstance(g, tuple):
                rows, g = g
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * g * g
            p[k][rows] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def gradients(p: dict, vocabulary: tuple, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of a batch of windows; ``vocabulary`` as from ``features``."""
    own, grams, ends = vocabulary
    used, at = np.unique(at, return_inverse=True)
    at = at.reshape(mask.shape)
    first = np.append(0, ends[:-1])[used]
    size = ends[used] - first
    gram = grams[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    gates = gates_of(p, own[used], gram, np.cumsum(size))
    logit, kept = forward(p, gates, at, mask, keep=True)
    prob = _sigmoid(logit)
    loss = float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum() / weight.sum())
    g, dg = backward(p, kept, ((prob - y) * weight / weight.sum()).astype(gates.dtype), mask)
    dgates = _scatter(at.ravel(), dg.reshape(-1, 6 * HIDDEN))[1]
    x = np.concatenate([p["word"][own[used]], _mean(p["gram"], gram, np.cumsum(size))], 1)
    g["W"] = (x.T @ dgates).reshape(p["W"].shape)
    g["b"] = dgates.sum(0).reshape(p["b"].shape)
    dx = dgates @ p["W"].reshape(2 * EMBED, -1).T
    g["word"] = _scatter(own[used], dx[:, :EMBED])
    g["gram"] = _scatter(gram, np.repeat(dx[:, EMBED:] / size[:, None].astype(dx.dtype), size, 0))
    return loss, g


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: each window's text, first word and end; a text without
    words has one empty window."""
    ends = np.cumsum(lengths)
    n = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (ends - lengths)[doc] + STRIDE * (np.arange(len(doc)) - (np.cumsum(n) - n)[doc])
    return doc, start, np.minimum(start + WINDOW, ends[doc])


def _places(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, np.append(codes, 0)[np.where(inside, at, len(codes))], 0), inside.astype(np.float32)


def logits(p: dict, gates: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = [forward(p, gates, *_places(codes, start[i:i + TOGETHER], end[i:i + TOGETHER]))[0] for i in range(0, len(start), TOGETHER)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _summary(doc: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Per document: the greatest number, the mean, the logarithm of how many; and 1."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    n = np.diff(np.append(first, len(doc)))
    return np.stack([np.maximum.reduceat(logit, first), np.add.reduceat(logit, first) / n, np.log(n), np.ones(len(n))], 1).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        prob = _sigmoid(x @ beta)
        slope = x.T @ (weight * (y - prob)) - ridge @ beta
        curve = (x * (weight * prob * (1 - prob))[:, None]).T @ x + ridge
        beta += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return beta


def train(texts: list[str], y: np.ndarray, share: float, seed: int = 7, rounds: int = 6) -> dict[str, np.ndarray]:
    """Network and calibration from labelled texts; ``share`` is the share of label 1 among all labelled rows."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    codes, lengths = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        for w in words(t):
            codes.append(np.fromiter(map(ids.__getitem__, w), np.int64, len(w)))
            lengths[i] += len(w)
    codes = np.concatenate([np.zeros(0, np.int64), *codes])
    vocabulary = features(list(ids) or [b"x"])
    doc, start, end = windows(lengths)
    rng = np.random.default_rng(seed)
    back = rng.random(len(texts)) < 0.2  # held back to calibrate
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y == 0).sum()))
    p = initial(seed)
    adam = _Adam(p, 0.01)

    def epoch(which: np.ndarray) -> None:
        # documents of both labels count equally, whatever their number of windows
        own = y[doc[which]]
        w = np.where(own > 0, 0.5 / max(1, (own > 0).sum()), 0.5 / max(1, (own == 0).sum())) * len(which)
        order = rng.permutation(len(which))
        for i in range(0, len(order), 256):
            some = which[order[i:i + 256]]
            _, g = gradients(p, vocabulary, *_places(codes, start[some], end[some]), own[order[i:i + 256]].astype(np.float32),
                             w[order[i:i + 256]].astype(np.float32))
            adam.step(p, g)

    use = np.flatnonzero(~back[doc])
    for _ in range(2):
        epoch(use)
    for r in range(rounds):
        adam.rate = 0.01 / (1 + r)
        logit = logits(p, gates_of(p, *vocabulary), codes, start, end)
        worst = np.lexsort((-logit, doc))
        first = np.append(True, doc[worst][1:] != doc[worst][:-1])
        top = worst[first]
        other = worst[~first]
        more = other[(y[doc[other]] == 0) & (rng.random(len(other)) < len(top) / max(1, len(other)))]
        chosen = np.concatenate([top, more])
        epoch(chosen[~back[doc[chosen]]])
    logit = logits(p, gates_of(p, *vocabulary), codes, start, end)
    held = back if len(set(y[back])) == 2 else np.ones(len(y), bool)
    p["beta"] = _logistic(_summary(doc, logit)[held], y[held], weight[held] * len(y))
    return p


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> dict | float:
    """The trained model, or the share of label 1 if there are not two labels to learn from.

    ``docs`` has doc_id and text, ``labels`` has doc_id and ``column`` (0: not; NULL teaches nothing).
    Trained on the first ``SAMPLE`` documents of each label in the order of a hash, as long as they have
    ``SAMPLE_WORDS`` words in all; the share of labels counts all rows.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(column) != 0).cast("int").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = dict(known.groupBy("y").count().collect())
    if len(counts) < 2:
        return float(bool(counts.get(1)))
    share = counts[1] / (counts[0] + counts[1])
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [known.filter(F.col("y") == v).orderBy(order, "doc_id").limit(n) for v, n in SAMPLE.items()]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most the SAMPLE
    sample = saved(sample.select("y", "text", order.alias("o")), "sample")
    most = SAMPLE_WORDS

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist())
        rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        texts, y, held = [], [], 0
        for _, label, text in rows:
            n = (text or "").count(" ") + 1
            if held + n <= most or not held:
                held += n
                texts.append(text)
                y.append(label)
        if len(set(y)) == 2:
            out = io.BytesIO()
            np.savez(out, **train(texts, np.array(y), share))
            yield pa.RecordBatch.from_pydict({"model": [out.getvalue()]})

    got = saved(sample.repartition(1).mapInArrow(fit, "model binary"), "model").first()
    return dict(np.load(io.BytesIO(got["model"]))) if got else share


class _Words:
    """Table of the gate inputs of the words that a task has met; emptied when it is full."""

    def __init__(self, p: dict):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.done = 0

    def table(self) -> np.ndarray:
        n = len(self.ids)
        if n > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros((n, 6 * HIDDEN), np.float32)])
        if n > self.done:
            from itertools import islice
            new = list(islice(self.ids, self.done, n))
            self.gates[self.done:n] = gates_of(self.p, *features(new))
            self.done = n
        return self.gates


def _batches(texts: Iterator[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BATCH or len(held) >= 2000:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    """doc_id, score (0 to 1), n_windows and worst (first word of the window with the greatest number) of
    each row of ``docs`` (doc_id, text).

    Whole texts are read. A NULL or empty text, or one without letters and digits, has one empty window.
    Equal texts have equal scores; repeated rows and NULL ids are scored like any other. Without a model
    all rows get the constant given instead. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def some(table: _Words, texts: list[str]) -> tuple[list, list, list]:
        if len(table.ids) > TABLE:
            table.clear()
        codes, lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for w in words(t):
                codes.append(np.fromiter(map(table.ids.__getitem__, w), np.int32, len(w)))
                lengths[i] += len(w)
        codes = np.concatenate([np.zeros(0, np.int32), *codes])
        doc, start, end = windows(lengths)
        logit = logits(table.p, table.table(), codes, start, end)
        order = np.lexsort((start, -logit, doc))
        top = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        prob = _sigmoid(_summary(doc, logit) @ table.p["beta"])
        return np.clip(prob, 0, 1).tolist(), np.bincount(doc).tolist(), (start[top] - (np.cumsum(lengths) - lengths)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        table = _Words(p) if isinstance(p, dict) else None
        for batch in batches:
            first = 0
            for texts in _batches(t.as_py() for t in batch.column(1)):
                n = len(texts)
                got = some(table, texts) if table else ([p] * n, [1] * n, [0] * n)
                ids = batch.column(0).slice(first, n)
                first += n
                yield pa.RecordBatch.from_arrays([ids, pa.array(got[0], pa.float64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())],
                                                 ["doc_id", "score", "n_windows", "worst"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, n_windows bigint, worst bigint")
