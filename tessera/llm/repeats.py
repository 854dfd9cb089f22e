"""Candidates for repeated passages, shared by the word and the byte deduplication.

All steps work on hashes; texts are shuffled only to be joined with the places found in them.

1. Anchors (see ``winnow``) are counted; those that occur once can't be part of a repeat.
2. The segments of repeated anchors are kept: *candidates*.
3. Segments that are equal as a whole are one *type*. A type that occurs again needs no closer
   look, so a passage that a third of all documents share collapses here, before any shuffle that
   gathers it. Only types that share their anchor with another type are compared further.
4. Those types are split in two: windows that contain the ``half`` units from the anchor on, and
   windows that contain the ``half`` units up to its end. A half whose units aren't repeated is
   dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import winnow
from .common import discard, row_key, saved


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of a row (see ``row_key``)."""
    d, th = row_key(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", "text", d.alias("d"), th.alias("th"))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _anchors(unit: str, length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in winnow.batches(_texts(batch.column(0))):
                got = winnow.segments(*winnow.UNITS[unit](texts), length, k)["anchor"]
                anchor, n = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    return run


def _segments(unit: str, length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in winnow.batches(_texts(batch.column(2))):
                s = winnow.segments(*winnow.UNITS[unit](texts), length, k)
                row = s["text"] + first
                cols = {"anchor": s["anchor"], "hash": s["hash"], "d": d[row], "th": th[row],
                        "start": s["start"].astype(np.int32), "shape": (s["n"] << 16 | s["off"]).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

    return run


def candidates(rows: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """Segments whose anchor occurs more than once: anchor, hash, d, th, start, shape."""
    counts = rows.select("text").mapInArrow(_anchors(unit, length, k), "anchor bigint, n bigint")
    repeated = saved(counts.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "anchors")
    found = rows.select("d", "th", "text").mapInArrow(
        _segments(unit, length, k), "anchor bigint, hash bigint, d bigint, th bigint, start int, shape int")
    segments = saved(found.join(repeated, "anchor"), "segments")
    discard(repeated)
    return segments


def types(segments: DataFrame) -> DataFrame:
    """Equal segments: anchor, hash, c (how many), first (the earliest: d, th, start, shape)."""
    return saved(segments.groupBy("anchor", "hash").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "th", "start", "shape")).alias("first")), "types")


def windows_of(shape: Column) -> Column:
    return F.shiftrightunsigned(shape, 16)


def halves(kinds: DataFrame, rows: DataFrame, unit: str, length: int, k: int, payload: str) -> DataFrame:
    """The halves, repeated by their context, of one occurrence of each type that isn't alone with
    its anchor.

    Columns: anchor, d, th, start and n (its windows), c, and ``windows`` (hashes of the windows)
    or ``bytes`` (the bytes that the windows cover).
    """
    half = min(2 * k, (length + k) // 2)
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor")
    firsts = (kinds.join(shared, "anchor").select("first.d", "first.th", F.struct("anchor", "first.start", "first.shape", "c").alias("s"))
              .groupBy("d", "th").agg(F.collect_list("s").alias("s")))
    kind = {"windows": "array<bigint>", "bytes": "binary"}[payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begin, end, found = flat(batch.column(3))
            for first, texts in winnow.batches(_texts(batch.column(2))):
                units, ends = winnow.UNITS[unit](texts)
                h = winnow.Hashes(units)
                rows_ = slice(first, first + len(texts))
                of = np.repeat(np.arange(len(texts)), end[rows_] - begin[rows_])
                every = slice(begin[first], end[first + len(texts) - 1])  # lists lie one after the other
                place, shape, anchor, c = (found[x][every] for x in ("start", "shape", "anchor", "c"))
                base = np.where(of > 0, ends[of - 1], 0)
                n, off = shape >> 16, shape & 0xFFFF
                at = place + off
                cut = np.clip(at - (length - half), place, place + n)  # windows before it lack the units after the anchor
                out: list[list[pa.Array]] = []
                for side, a, b, ctx in ((0, cut, place + n, at), (1, place, cut, at + k - half)):
                    ok = b > a
                    o, a, b, ctx = of[ok], a[ok], b[ok], (ctx + base)[ok]
                    context = h.runs(ctx, ctx + half).view(np.int64)
                    lo = (a + base[ok]).tolist()
                    if payload == "windows":
                        size = b - a
                        starts = np.repeat(np.array(lo, np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        every_window = h.runs(starts, starts + length).view(np.int64)
                        data = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(every_window))
                    else:
                        text = b"".join(texts)
                        data = pa.array([text[x:x + m + length - 1] for x, m in zip(lo, (b - a).tolist())], pa.binary())
                    out.append([pa.array(anchor[ok]), pa.array(np.full(len(a), side, np.int32)), pa.array(context), pa.array(d[o + first]),
                                pa.array(th[o + first]), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(c[ok]), data])
                for cols in out:
                    yield pa.RecordBatch.from_arrays(cols, ["anchor", "side", "context", "d", "th", "start", "n", "c", payload])

    found = saved(rows.select("d", "th", "text").join(firsts, ["d", "th"]).select("d", "th", "text", "s").mapInArrow(
        run, f"anchor bigint, side int, context bigint, d bigint, th bigint, start int, n int, c bigint, {payload} {kind}"), "halves")
    alive = found.groupBy("anchor", "side", "context").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    kept = saved(found.join(alive, ["anchor", "side", "context"]).drop("side", "context"), "alive")
    discard(found)
    return kept


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Each row of ``rows`` with the list ``p`` of its places (start, n); NULL if it has none."""
    # wholly repeated rows have the same places: each is kept once, before the shuffle
    by_row = places.groupBy("d", "th").agg(F.collect_set(F.struct("start", "n")).alias("p"))
    return rows.join(by_row, ["d", "th"], "left").select("doc_id", "text", "p")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs as arrays: where each row's list begins and ends (a NULL list is
    empty), and the fields of all elements."""
    ends = column.offsets.to_numpy()
    null = column.is_null().to_numpy(zero_copy_only=False)
    values = column.values
    fields = {f.name: values.field(i).to_numpy().astype(np.int64) for i, f in enumerate(values.type)}
    return ends[:-1], np.where(null, ends[:-1], ends[1:]), fields


def covered(size: int, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` units the windows of ``length`` units cover, n of them from each start."""
    if not len(start):
        return np.zeros(size, bool)
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + n + length - 1, minlength=size + 1)
    return np.cumsum(edge)[:size] > 0
