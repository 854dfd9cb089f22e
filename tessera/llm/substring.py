"""Substring deduplication on words by level-wise doubling (dealt operator 1).

A word goes if it is covered by a window of ``length`` words that occurs more than once. Windows
are found level by level: windows of a quarter of the length are counted first (only the anchors
that winnowing picks, so that each full window has one); those repeated are extended to half the
length, those still repeated to the full length, until no candidates survive (see ``repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved
from .repeats import candidates, covered, flat, halves, keyed, types, windows_of, with_places


def repeated_words(docs: DataFrame, length: int = 35) -> DataFrame:
    """Remove words covered by repeated windows of ``length`` words.

    Returns per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words left,
    joined by one space). Both copies of a repeat go, in one document or in several; repeated rows
    are copies of each other. NULL and empty texts have no words, and texts shorter than the
    window lose none. Windows are compared by 128 bits of hashes. An empty table gives no rows;
    other columns are not read.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    rows = keyed(docs)
    k = -(-length // 4)
    segments = candidates(rows, "words", length, k)
    kinds = types(segments)
    # whole segments that occur again
    again = kinds.filter("c > 1").select("anchor", "hash")
    whole = saved(segments.join(again, ["anchor", "hash"]).select("d", "th", "start", windows_of(F.col("shape")).alias("n")), "whole")
    discard(segments)
    # windows of the others, against all that share their anchor
    alive = halves(kinds, rows, "words", length, k, "windows")
    open_ = alive.select("anchor", "d", "th", "start", "c", F.posexplode("windows").alias("i", "w"))
    twice = open_.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    single = (open_.filter("c = 1").join(twice, ["anchor", "w"])
              .select("d", "th", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n")))
    places = saved(whole.unionByName(single), "places")
    discard(kinds, whole, alive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            begin, end, found = flat(batch.column(2))
            for text, a, b in zip(batch.column(1), begin, end):
                words = (text.as_py() or "").encode().split()
                gone = covered(len(words), found["start"][a:b], found["n"][a:b], length)
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, g in zip(words, gone.tolist()) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    return with_places(rows, places).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
