"""Suffix-array deduplication on bytes (dealt operator 4).

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier. Strings that
can repeat are found by their anchors (see ``repeats``); whole segments that repeat are settled by
their first occurrence. What is left, occurrences that share an anchor in different surroundings,
is sorted by suffixes, all occurrences of an anchor in one block:

* *Two-stage sorting.* Only suffixes smaller than their successors are sorted directly, to a depth
  of at least ``length``. The others are induced: buckets (by first byte) are scanned in order, and
  a suffix is appended to its bucket when its successor is passed.
* *Adjacent common prefixes.* Neighbours in the suffix array with a common prefix of at least
  ``length`` bytes are the same string; all but the earliest start are removed.

An anchor with more than ``HOT`` kinds of surroundings isn't gathered in one block: the hashes of
its strings are compared by a grouped aggregate instead, which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .common import discard, saved
from .repeats import candidates, covered, flat, halves, keyed, types, windows_of, with_places

#: Most occurrences of one anchor that are sorted in one block.
HOT = 10_000
#: Bytes of a block, about.
BLOCK = 1 << 20


def _words(t: np.ndarray) -> np.ndarray:
    """At each place the next eight symbols as one number, zeros after the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j:j + len(t)]
    return out


def _direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the first ``depth`` symbols of the suffixes that start there."""
    at = at[np.argsort(words[at], kind="stable")]
    new = np.append(True, words[at][1:] != words[at][:-1])
    for j in range(8, depth, 8):
        tied = ~(new & np.append(new[1:], True))
        sub = np.flatnonzero(tied)
        if not len(sub):
            break
        group = np.cumsum(new)[sub]
        place = at[sub] + j
        key = np.where(place < len(words), words[np.minimum(place, len(words) - 1)], 0)
        order = np.lexsort((key, group))
        at[sub] = at[sub][order]
        key, group = key[order], group[order]
        new[sub] = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    return at


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``t`` (uint8, ends with 0) in the order of the suffixes' first ``depth`` symbols,
    by two-stage sorting."""
    n = len(t)
    # smaller than its successor: the next other symbol is larger
    run_end = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    nxt = np.append(t[run_end[:-1] + 1], 255)
    small = np.repeat(nxt > t[run_end], np.diff(run_end, prepend=-1))
    words = _words(t)
    direct = _direct(np.flatnonzero(small), words, depth)
    first = t[direct]
    bounds = np.searchsorted(first, np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in np.unique(t).tolist():
        level = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        induced = [level]
        while len(level):  # runs of c: the place before an induced one is the next induced
            level = level[level > 0] - 1
            level = level[(t[level] == c) & ~small[level]]
            induced.append(level)
        bucket = np.concatenate([*induced, direct[bounds[c]:bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        symbol = t[before]
        before, symbol = before[symbol > c], symbol[symbol > c]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        edges = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else []
        for a, b in zip(edges, np.append(edges, len(symbol))[1:]):
            queue[symbol[a]].append(before[a:b])
        queue[c] = []
    got = np.concatenate(out)
    assert len(got) == n
    return got


def common_prefixes(a: np.ndarray, b: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for j in range(0, most, 8):
        x = words[np.minimum(a[open_] + j, len(words) - 1)] ^ words[np.minimum(b[open_] + j, len(words) - 1)]
        same = np.zeros(len(x), np.int64)
        for byte in range(1, 9):
            same += (x >> np.uint64(64 - 8 * byte)) == 0
        out[open_] = j + same
        open_ = open_[x == 0]
        if not len(open_):
            break
    return np.minimum(out, most)


def _later(block: list[dict], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(d, th, start, n) of the strings of a block that also start earlier."""
    # UTF-8 has no bytes C0, C1 or from F5 on, so all bytes move up and 0 is free to end a segment
    up = _symbols()
    t = np.concatenate([x for s in block for x in (up[np.frombuffer(s["bytes"], np.uint8)], np.zeros(1, np.uint8))])
    n = np.array([s["n"] for s in block])
    begin = np.cumsum([0, *(len(s["bytes"]) + 1 for s in block[:-1])])
    rank = np.empty(len(block), np.int64)  # by (d, th): what is earlier
    rank[sorted(range(len(block)), key=lambda i: (block[i]["d"], block[i]["th"], block[i]["start"]))] = np.arange(len(block))
    segment = np.full(len(t), -1)
    inside = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    segment[inside] = np.repeat(np.arange(len(block)), n)
    order = suffix_array(t, length)
    order = order[segment[order] >= 0]  # strings of full length only
    lcp = common_prefixes(order[:-1], order[1:], _words(t), length)
    same = np.cumsum(np.append(True, lcp < length))
    of = segment[order]
    start = np.array([s["start"] for s in block])[of] + order - begin[of]
    doc = np.unique([(s["d"], s["th"]) for s in block], axis=0, return_inverse=True)[1].reshape(-1)[of]
    by = np.lexsort((start, doc, same))
    first = np.append(True, same[by][1:] != same[by][:-1])
    # the same place may be in the block once only; all after the first of a class go
    gone = np.sort(order[by[~first]])
    if not len(gone):
        return
    cut = np.flatnonzero(np.append(True, np.diff(gone) != 1) | np.append(True, np.diff(segment[gone]) != 0))
    for a, b in zip(cut, np.append(cut[1:], len(gone))):
        s = block[segment[gone[a]]]
        yield s["d"], s["th"], int(s["start"] + gone[a] - begin[segment[gone[a]]]), int(b - a)


def _symbols() -> np.ndarray:
    return np.array([b + 1 if b < 0xC0 else b for b in range(256)], np.uint8)


def _sort_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: list[dict]) -> pa.RecordBatch:
            cols = list(zip(*_later(block, length))) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                              ["d", "th", "start", "n"])

        block: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held >= BLOCK and row["anchor"] != block[-1]["anchor"]:
                    yield flush(block)
                    block, held = [], 0
                block.append(row)
                held += len(row["bytes"])
        if block:
            yield flush(block)

    return run


def _string_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            lists = []
            for text in texts:
                h = winnow.Hashes(winnow.byte_units([text])[0])
                lists.append(h.windows(length).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists, pa.list_(pa.int64()))],
                                             ["anchor", "d", "th", "start", "w"])

    return run


def later_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove bytes covered by strings of ``length`` UTF-8 bytes that also start earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start; NULL ids come
    first, and rows with equal ids and different texts are ordered by a hash of the text. Rows that
    are wholly equal, id included, are one document and don't remove each other. Returns per row of
    ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept
    (binary: the remaining bytes, which may cut a character). NULL and empty texts have no bytes.
    An empty table gives no rows; other columns are not read.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    rows = keyed(docs)
    k = max(4, length * 8 // 25)
    segments = candidates(rows, "bytes", length, k)
    kinds = types(segments)
    # whole segments but for the first of each type
    again = kinds.filter("c > 1").select("anchor", "hash", "first")
    place = F.struct("d", "th", "start", "shape")
    whole = saved(segments.join(again, ["anchor", "hash"]).filter(place != F.col("first"))
                  .select("d", "th", "start", windows_of(F.col("shape")).alias("n")), "whole")
    discard(segments)
    open_ = halves(kinds, rows, "bytes", length, k, "bytes")
    hot = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT).select("anchor")
    few = open_.join(hot, "anchor", "left_anti").select("anchor", "d", "th", "start", "n", "bytes")
    shape = "d bigint, th bigint, start int, n int"
    sorted_ = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_blocks(length), shape)
    strings = (open_.join(hot, "anchor").select("anchor", "d", "th", "start", "bytes")
               .mapInArrow(_string_hashes(length), "anchor bigint, d bigint, th bigint, start int, w array<bigint>")
               .select("anchor", "d", "th", "start", F.posexplode("w").alias("i", "w"))
               .select("anchor", "w", F.struct("d", "th", (F.col("start") + F.col("i")).alias("start")).alias("at")))
    earliest = strings.groupBy("anchor", "w").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    hashed = strings.join(earliest, ["anchor", "w"]).filter("at != first").select("at.d", "at.th", "at.start", F.lit(1).alias("n"))
    places = saved(whole.unionByName(sorted_).unionByName(hashed), "places")
    discard(kinds, whole, open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            begin, end, found = flat(batch.column(2))
            for text, a, b in zip(batch.column(1), begin, end):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                gone = covered(len(data), found["start"][a:b], found["n"][a:b], length)
                for col, v in zip(out, (len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)),
                                        data[~gone].tobytes())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_places(rows, places).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
