"""Toxicity: gradients against differences, scores against a plain loop, accuracy on held-out documents."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T

from .conftest import odd_rows


def small_model(seed=3):
    p = {k: v.astype(np.float64) for k, v in T.initial(seed).items()}
    rng = np.random.default_rng(seed)
    for k in ("b", "ba", "bo"):
        p[k] = rng.normal(0, 0.3, p[k].shape)
    return p


def test_gradients_equal_differences():
    p = small_model()
    vocabulary = T.features([f"w{i}".encode() * (i % 3 + 1) for i in range(20)])
    rng = np.random.default_rng(1)
    at = rng.integers(0, 20, (5, 6))
    mask = (np.arange(6) < np.array([6, 6, 4, 1, 0])[:, None]).astype(float)
    at = np.where(mask > 0, at, 0)
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5, 1])
    _, g = T.gradients(p, vocabulary, at, mask, y, weight)
    for name, found in g.items():
        rows, values = found if isinstance(found, tuple) else (None, found)
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in values.shape)
            place = (rows[i[0]], *i[1:]) if rows is not None else i
            old = p[name][place]
            both = []
            for e in (1e-5, -1e-5):
                p[name][place] = old + e
                both.append(T.gradients(p, vocabulary, at, mask, y, weight)[0])
            p[name][place] = old
            assert abs((both[0] - both[1]) / 2e-5 - values[i]) < 1e-6, name


def plain(p, text):
    """Score of a text, window by window and word by word."""
    words = [w for part in T.words(text) for w in part]
    starts = range(0, max(1, len(words) - T.WINDOW + T.STRIDE), T.STRIDE)
    numbers = []
    h = T.HIDDEN
    for a in starts:
        x = [T.gates_of(p, *T.features([w])).reshape(2, 3 * h) for w in words[a:a + T.WINDOW]]
        states = []
        for d in (0, 1):
            s, run = np.zeros(h), []
            for g in (x if d == 0 else x[::-1]):
                r = s @ p["U"][d]
                z, q = (1 / (1 + np.exp(-(g[d][i * h:(i + 1) * h] + r[i * h:(i + 1) * h]))) for i in (0, 1))
                s = (1 - z) * s + z * np.tanh(g[d][2 * h:] + q * r[2 * h:])
                run.append(s)
            states.append(run if d == 0 else run[::-1])
        both = [np.concatenate(s) for s in zip(*states)]
        e = [math.exp(np.tanh(s @ p["Wa"] + p["ba"]) @ p["u"]) for s in both]
        pooled = sum((w / sum(e) * s for w, s in zip(e, both)), np.zeros(2 * h))
        numbers.append(float(pooled @ p["wo"] + p["bo"][0]))
    beta = p["beta"]
    x = beta @ [max(numbers), sum(numbers) / len(numbers), math.log(len(numbers)), 1]
    return 1 / (1 + math.exp(-x)), len(numbers), T.STRIDE * numbers.index(max(numbers))


def test_scores_equal_a_plain_loop(make, monkeypatch):
    p = small_model() | {"beta": np.array([1.5, 0.5, -0.1, 0.2])}
    monkeypatch.setattr(T, "CHUNK", 40)
    monkeypatch.setattr(T, "TOGETHER", 7)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "bad!", "élan", "中文", "word", "x" * 90]) for _ in range(n)), "en") for i, n in enumerate([0, 1, 31, 32, 33, 47, 48, 49, 200])]
    rows += [r for r in odd_rows() if len(r[1] or "") < 4000]
    got = T.score(make(rows), p).collect()
    assert len(got) == len(rows)
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: str(r)), sorted(rows, key=str)):
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 1}
    for i, text, *_ in rows:
        if i in by_id and i not in (0, 1, 2, 3, 4, 5, 6, 7, 8):
            want, n, worst = plain(p, text)
            assert abs(by_id[i].score - want) < 1e-5 and by_id[i].n_windows == n and by_id[i].worst == worst
    for n, (_, text, *_) in enumerate(rows[:9]):
        want, count, worst = plain(p, text)
        assert any(abs(r.score - want) < 1e-5 and r.n_windows == count and r.worst == worst for r in got if r.doc_id == n)


def test_nothing_to_learn_from(make, spark):
    labels = "doc_id bigint, quality int, toxic int"
    docs = make(odd_rows())
    for rows, want in (([], 0.0), ([(1, 1, None), (None, 1, 1), (77, 1, 1)], 0.0), ([(1, 1, 0), (5, 1, 0)], 0.0), ([(5, 1, 1)], 1.0)):
        model = T.learn(docs, spark.createDataFrame(rows, labels))
        assert model == want
        got = T.score(docs, model).collect()
        assert len(got) == len(odd_rows()) and {r.score for r in got} == {want}
    assert T.score(make([]), 0.5).collect() == []


def test_accuracy_on_held_out_documents(spark):
    """Over the whole table: at the contract's threshold nearly all are right, in both labels."""
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op11_toxicity"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "n_windows", "worst"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL")
    rows = got.join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in rows}
    assert share[1] >= 0.85 and share[0] <= 0.03
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
