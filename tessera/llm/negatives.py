"""Hard-negative mining by inner product (dealt operator 13).

Rows are packed into R-trees by sort-tile-recursion: a range partitioning by label and first
coordinate cuts slabs, a second one by the next coordinate cuts each slab into *units*, and inside a
unit the recursion goes on over the remaining coordinates down to leaves of ``LEAF`` rows. A unit is one
tree and one row of a Parquet table, so a search reads trees, never single rows.

A tree's minimum bounding boxes bound the inner products with an anchor from both sides. A best-first
queue opens the box with the highest upper bound first and drops boxes that lie outside all of the
anchor's score windows, hold no row of the wanted labels, or lie strictly below the k-th score found.
The anchor's own unit is searched first: its k-th score already prunes the other units.

Anchors are a stated query set and meet all units in blocks; each (block, unit) pair is a task of
bounded size. What a pair finds is at most k rows a window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, saved

LEAF = 256
FANOUT = 16
#: Rows of a unit: about 256 units, within these bounds; a tree is cut at twice the upper one.
UNIT_ROWS = (4096, 1 << 18)
#: Anchors of a block, and how many of them have their bounds computed at a time.
BLOCK = 8192
STEP = 256
_LAST = (1 << 63) - 1  # stands for a NULL id, which comes last among ties


def _pack(q: np.ndarray) -> bytes:
    small = not q.size or np.abs(q).max() < 1 << 15
    return q.astype(np.int16 if small else np.float64).tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * n * dim else np.float64
    return np.frombuffer(data, kind).reshape(n, dim)


def _tile(label: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by sort-tile-recursion, and where leaves start in it."""
    leaves: list[np.ndarray] = []

    def cut(rows: np.ndarray, coordinate: int) -> None:
        pages = math.ceil(len(rows) / LEAF)
        left = q.shape[1] + 1 - coordinate
        if pages <= 1 or left <= 0:
            leaves.extend(rows[i:i + LEAF] for i in range(0, len(rows), LEAF))
            return
        slabs = math.ceil(pages ** (1 / left) - 1e-9)
        keys = label[rows] if coordinate == 0 else q[rows, coordinate - 1]
        rows = rows[np.argsort(keys, kind="stable")]
        size = math.ceil(pages / slabs) * LEAF
        for i in range(0, len(rows), size):
            cut(rows[i:i + size], coordinate + 1)

    cut(np.arange(len(label)), 0)
    starts = np.cumsum([0, *map(len, leaves[:-1])])
    return np.concatenate(leaves), starts


def _build(dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, part = TaskContext.get().partitionId(), 0

        def tree(held: list[tuple]) -> pa.RecordBatch:
            label, ids, anchor, q = (np.concatenate(x) for x in zip(*held))
            order, starts = _tile(label, q)
            label, ids, anchor, q = label[order], ids[order], anchor[order], q[order]
            cols = {"unit": unit, "part": part, "n": len(ids), "ids": ids.tobytes(), "labels": label.tobytes(), "anchors": anchor.tobytes(),
                    "q": _pack(q), "starts": starts.astype(np.int64).tobytes(),
                    "low": np.minimum.reduceat(q, starts).tobytes(), "high": np.maximum.reduceat(q, starts).tobytes()}
            return pa.RecordBatch.from_pylist([cols], pa.schema(
                [("unit", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in list(cols)[3:])]))

        held: list[tuple] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(3)
            ends = vectors.offsets.to_numpy()
            q = np.zeros((batch.num_rows, dim))  # missing components of shorter vectors are 0
            lengths = np.diff(ends)
            at = np.repeat(np.arange(len(lengths)), lengths)
            q[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], lengths)] = np.floor(scale * vectors.flatten().to_numpy())
            ids = batch.column(1).fill_null(_LAST).to_numpy()
            anchor = batch.column(2).to_numpy(zero_copy_only=False)
            held.append((batch.column(0).to_numpy(), ids, anchor, q))
            size += batch.num_rows
            if size >= 2 * UNIT_ROWS[1]:
                yield tree(held)
                held, size, part = [], 0, part + 1
        if held:
            yield tree(held)

    return run


PAGES = "unit int, part int, n int, ids binary, labels binary, anchors binary, q binary, starts binary, low binary, high binary"


def trees(rows: DataFrame, anchor: Column, scale: float) -> tuple[DataFrame, int]:
    """R-trees over ``rows`` (id, label, vector), one row a tree, and the number of components."""
    ok = rows.filter("label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) "
                     f"AND abs(x) <= {1.7e308 / max(1.0, scale)!r}D)")
    ok = ok.select(F.col("label").cast("long").alias("label"), F.col("id").cast("long").alias("id"),
                   F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    n, dim = ok.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    per_unit = min(max(n // 256, UNIT_ROWS[0]), UNIT_ROWS[1])
    units = max(1, math.ceil(n / per_unit))
    slabs = math.ceil(math.sqrt(units))
    first, second = F.expr("get(vector, 0)"), F.expr("get(vector, 1)")
    slab = ok.repartitionByRange(slabs, "label", first, "id").withColumn("slab", F.spark_partition_id())
    unit = slab.repartitionByRange(units, "slab", second, "id").select("label", "id", "anchor", "vector")
    return saved(unit.mapInArrow(_build(dim or 0, scale), PAGES), "trees"), dim or 0


def _anchors(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(t["anchors"], bool))
                q = _unpack(t["q"], t["n"], dim)[at].astype(np.float64)
                uid = (t["unit"] << 40) + (t["part"] << 32) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array(np.full(len(at), t["unit"], np.int32)), pa.array(np.frombuffer(t["ids"], np.int64)[at]),
                     pa.array(np.frombuffer(t["labels"], np.int64)[at]), pa.array([x.tobytes() for x in q], pa.binary())],
                    ["uid", "unit", "id", "label", "q"])

    return run


class _Tree:
    """One tree and its boxes: leaves first, then each level above them, the root last."""

    def __init__(self, t: dict, dim: int):
        self.ids, self.labels = (np.frombuffer(t[c], np.int64) for c in ("ids", "labels"))
        self.base = (t["unit"] << 40) + (t["part"] << 32)
        self.q = _unpack(t["q"], t["n"], dim)
        starts = np.frombuffer(t["starts"], np.int64)
        self.edges = np.append(starts, t["n"])
        low, high = (np.frombuffer(t[c]).reshape(-1, dim) for c in ("low", "high"))
        lab = [np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)]
        boxes, self.children, first = [(low, high, *lab)], [None] * len(starts), 0
        while len(boxes[-1][0]) > 1:
            at = np.arange(0, len(boxes[-1][0]), FANOUT)
            size = len(boxes[-1][0])
            self.children += [range(first + a, first + min(a + FANOUT, size)) for a in at.tolist()]
            first += size
            boxes.append(tuple(f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), boxes[-1])))
        self.low, self.high, self.least, self.most = (np.concatenate(x) for x in zip(*boxes))
        size = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))
        self.size, self.scored = size, {}

    def leaf(self, i: int, kind) -> np.ndarray:
        """A leaf's rows in the number type in which their inner products are exact."""
        key = (i, kind)
        if key not in self.scored:
            rows = self.q[self.edges[i]:self.edges[i + 1]]
            self.scored[key] = rows.astype(kind) if kind is not object else np.array([[int(x) for x in r] for r in rows.tolist()], object)
        return self.scored[key]


def _find(tree: _Tree, anchors: dict[str, list], q: np.ndarray, k: int, same: bool) -> Iterator[tuple[int, int, list]]:
    """(anchor, window, its first k (-score, id) in this tree) for a few anchors."""
    slack = 0.0
    most = float(np.abs(q).max(initial=0)) * tree.size * max(1, q.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    upper = plus @ tree.high.T + minus @ tree.low.T
    lower = plus @ tree.low.T + minus @ tree.high.T
    if kind is object:  # bounds in double are then rounded: widen them
        slack = most * 1e-9
    own = q.astype(kind) if kind is not object else np.array([[int(x) for x in r] for r in q.tolist()], object)
    root = len(tree.children) - 1
    for a in range(len(q)):
        label, uid = anchors["label"][a], anchors["uid"][a]
        useful = (tree.least <= label) & (label <= tree.most) if same else (tree.least != label) | (tree.most != label)
        windows = [(lo, hi, [], least) for lo, hi, least in zip(anchors["lo"][a], anchors["hi"][a], anchors["least"][a])]
        high, low = (upper[a] + slack).tolist(), (lower[a] - slack).tolist()
        queue = [(-high[root], root)] if useful[root] else []
        while queue:
            top, node = heapq.heappop(queue)
            open_ = [w for w in windows if -top >= w[0] and low[node] <= w[1] and min(-top, w[1]) >= _floor(w, k)]
            if not open_:
                continue
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if useful[child]:
                        heapq.heappush(queue, (-high[child], child))
                continue
            begin, end = tree.edges[node], tree.edges[node + 1]
            score = tree.leaf(node, kind) @ own[a]
            fit = (tree.labels[begin:end] == label) == same
            if same and tree.base + begin <= uid < tree.base + end:
                fit[uid - tree.base - begin] = False
            for lo, hi, found, least in open_:
                at = np.flatnonzero(fit & (score >= max(lo, _floor((lo, hi, found, least), k))) & (score <= hi))
                if len(at) > k:  # all that tie with the k-th stay, ids decide
                    s = score[at]
                    at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
                for s, i in zip(score[at].tolist(), tree.ids[begin + at].tolist()):
                    found.append((-int(s), i))
                if len(at):
                    found.sort()
                    del found[k:]
        for j, w in enumerate(windows):
            if w[2]:
                yield a, j, w[2]


def _floor(window: tuple, k: int) -> float:
    """Scores strictly below this can't be among the window's first k."""
    _, _, found, least = window
    return max(least, -found[-1][0]) if len(found) >= k else least


def _search(k: int, same: bool, dim: int):
    """A block of anchors against the trees of a unit: uid, window, ids and scores, best first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"uid": [], "w": [], "ids": [], "scores": []}
        for part in right.to_pylist() if left.num_rows else []:
            tree = _Tree(part, dim)
            for i in range(0, left.num_rows, STEP):
                some = left.slice(i, STEP).to_pydict()
                q = np.frombuffer(b"".join(some["q"])).reshape(-1, dim)
                for a, w, found in _find(tree, some, q, k, same):
                    out["uid"].append(some["uid"][a])
                    out["w"].append(w)
                    out["ids"].append([x for _, x in found])
                    out["scores"].append([max(-_LAST, min(_LAST, -s)) for s, _ in found])
        return pa.table({"uid": pa.array(out["uid"], pa.int64()), "w": pa.array(out["w"], pa.int32()),
                         "ids": pa.array(out["ids"], pa.list_(pa.int64())), "scores": pa.array(out["scores"], pa.list_(pa.int64()))})

    return run


FOUND = "uid bigint, w int, ids array<bigint>, scores array<bigint>"


def _best(found: DataFrame, k: int) -> DataFrame:
    """uid, w, rank, id, score: the first k rows of each window over all units."""
    each = found.select("uid", "w", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("uid", "w", "x.ids", "x.scores")
    order = Window.partitionBy("uid", "w").orderBy(F.desc("scores"), F.asc("ids"))
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).selectExpr("uid", "w", "rank", "ids AS id", "scores AS score")


def _first(anchors: DataFrame, pages: DataFrame, k: int, same: bool, dim: int, n_units: int) -> DataFrame:
    """The first k rows of each window of each anchor; ``anchors`` has lo and hi, one entry a window."""
    # the own unit's k-th score is a lower bound for the k-th of all
    open_ = anchors.withColumn("least", F.transform("lo", lambda _: F.lit(-math.inf)))
    own = open_.groupBy("unit").cogroup(pages.groupBy("unit")).applyInArrow(_search(k, same, dim), FOUND)
    kth = own.filter(F.size("scores") >= k).select("uid", "w", F.element_at("scores", -1).cast("double").alias("s"))
    kth = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("kth"))
    # a score beyond 2**53 may have been rounded up by the cast
    least = F.transform("lo", lambda _, i: F.coalesce(F.expr("kth")[i] - F.when(F.abs(F.expr("kth")[i]) >= 2.0**53, F.abs(F.expr("kth")[i]) * 1e-15).otherwise(0.0), F.lit(-math.inf)))
    seeded = saved(anchors.join(kth, "uid", "left").withColumn("least", least).drop("kth", "unit"), "anchors")
    n_blocks = max(1, math.ceil(seeded.count() / BLOCK))
    left = seeded.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int")).withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(n_units - 1))))
    right = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = saved(left.groupBy("block", "unit").cogroup(right.groupBy("block", "unit")).applyInArrow(_search(k, same, dim), FOUND), "found")
    discard(seeded)
    return _best(found, k)


def hard_negatives(rows: DataFrame, anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   low: int = 3, high: int = 9) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` tenths of the positive's.

    ``rows`` has id, label and vector; other columns are only read by ``anchor``, the condition that
    makes a row an anchor. Components become floor(scale * x); scores are integer inner products, higher
    ones first, ties by smaller id. Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    Rows with a NULL label or vector, or with a NULL or non-finite component (before or after scaling),
    take no part. Missing components of shorter vectors count 0; empty vectors score 0. Repeated rows and
    rows of equal id are rows of their own. A NULL id is never an anchor by itself, and comes last among
    ties. A positive with a score below 0 has no negatives. Scores are exact; beyond the range of a long
    they are reported as its end, and window edges beyond 2**53 are rounded to doubles. An empty table
    gives no rows.
    """
    pages, dim = trees(rows, anchor, scale)
    n_units = (pages.agg(F.max("unit")).first()[0] or 0) + 1
    anchors = saved(pages.select("unit", "part", "n", "ids", "labels", "anchors", "q").mapInArrow(
        _anchors(dim), "uid bigint, unit int, id bigint, label bigint, q binary"), "anchors")
    every = anchors.withColumn("lo", F.array(F.lit(-math.inf))).withColumn("hi", F.array(F.lit(math.inf)))
    near = saved(_first(every, pages, positives, True, dim, n_units)
                 .select("uid", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # tenths of a score without passing 64 bits: p = 10 t + r
    t, r = F.expr("(positive_score - pmod(positive_score, 10)) div 10"), F.expr("pmod(positive_score, 10)")
    window = F.struct("rank", (t * low + F.ceil(r * low / 10)).cast("double").alias("lo"), (t * high + F.floor(r * high / 10)).cast("double").alias("hi"))
    windows = near.groupBy("uid").agg(F.sort_array(F.collect_list(window)).alias("x")).select("uid", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    found = _first(anchors.join(windows, "uid"), pages, negatives, False, dim, n_units)
    found = found.select("uid", (F.col("w") + 1).alias("p"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(near.withColumnRenamed("rank", "p"), ["uid", "p"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    named = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return out.select(named("anchor_id"), named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")
