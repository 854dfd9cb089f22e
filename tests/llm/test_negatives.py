"""Hard negatives against scoring every anchor with every row."""

import math
import random

from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "id bigint, label int, vector array<float>, unit int, q string, uid double"


def brute(rows, scale=256):
    """All (anchor, positive, rank, negative, scores), from lists of exact integers."""
    ok = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, lab, v in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (aid, alab, av) in enumerate(ok):
        if aid is None or aid % 100:
            continue
        score = [(-sum(x * y for x, y in zip(av, v)), late(i), i, lab) for b, (i, lab, v) in enumerate(ok) if b != a]
        for ps, _, pid, _ in sorted(x for x in score if x[3] == alab)[:5]:
            fit = sorted(x for x in score if x[3] != alab and -30 * ps <= -100 * x[0] <= -90 * ps)[:10]
            out += [(aid, pid, r, nid, -ps, -ns) for r, (ns, _, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA)
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def cloud(n, dim, seed, labels=4):
    rng = random.Random(seed)
    # steps of 1/16 make many equal scores; a third of all rows have one label
    return [(i, rng.choice([0, *range(labels)]) if i % 3 else 1, [rng.randrange(-8, 24) / 16 for _ in range(dim)]) for i in range(n)]


def test_equals_brute_force_with_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "UNIT_ROWS", (100, 150))
    rows = cloud(900, 3, 1)
    got = mined(spark, rows)
    assert got == brute(rows)
    assert len(got) > 200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(150, 4, 2, labels=2) + [
        (200, None, [1.0] * 4), (300, 1, None), (400, 1, [1.0, None, 0.0, 0.0]), (500, 1, [nan, 0.0, 0.0, 0.0]), (600, 0, [inf, 0.0, 0.0, 0.0]),
        (700, 1, []), (800, 1, [1.0]), (None, 0, [1.0] * 4), (None, 1, [1.0] * 4), (100, 0, [0.5] * 4), (100, 0, [0.5] * 4), (0, 1, [0.0] * 4),
        (900, 1, [-1.0, -1.0, -1.0, -1.0]), (1000, 0, [3.0] * 9)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [float(rng.randrange(1 << 20)) for _ in range(3)]) for i in range(0, 800, 20)]
    assert mined(spark, rows) == brute(rows)


def test_one_label_and_no_rows(spark):
    assert mined(spark, [(i, 1, [1.0, 2.0]) for i in range(150)]) == []
    assert mined(spark, []) == []


def test_boxes_prune(monkeypatch):
    """Far clusters are never opened once the first k rows are known."""
    import numpy as np
    rng = np.random.default_rng(0)
    q = np.concatenate([np.floor(rng.normal(c, 3, (512, 2))) for c in (0, 200, 400, 600)])
    label = np.ones(len(q), np.int64)
    order, starts = negatives._tile(label, q)
    q = q[order]
    tree = negatives._Tree({"unit": 0, "part": 0, "n": len(q), "ids": np.arange(len(q)).tobytes(), "labels": label.tobytes(), "q": negatives._pack(q),
                            "starts": starts.astype(np.int64).tobytes(), "low": np.minimum.reduceat(q, starts).tobytes(), "high": np.maximum.reduceat(q, starts).tobytes()}, 2)
    opened = []
    leaf = tree.leaf
    tree.leaf = lambda i, kind: opened.append(i) or leaf(i, kind)
    some = {"uid": [-1], "label": [1], "lo": [[-math.inf]], "hi": [[math.inf]], "least": [[-math.inf]]}
    (_, _, found), = negatives._find(tree, some, np.array([[1.0, 1.0]]), 5, True)
    best = sorted((-int(s), i) for i, s in enumerate(q @ [1.0, 1.0]))[:5]
    assert found == best
    assert len(opened) <= len(starts) // 3
