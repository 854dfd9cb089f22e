"""Best-fit packing of token sequences by linear grouping (dealt operator 3).

Spark does the work that grows with the corpus: tokenising, the histogram of piece lengths,
ranking pieces of equal length and attaching each piece to its place. What the driver plans
on is the histogram alone, which has at most ``max_len`` entries whatever the corpus size:

1. *Linear grouping*: large lengths are sorted and cut into groups of equal cardinality; every
   length of a group counts as the group's largest.
2. *Configurations*: over those few sizes a bounded knapsack finds the fullest configuration the
   remaining demand allows; it is used as often as the demand lasts, then the next one is found.
3. *Substitution*: the slots of a configuration are filled with the group's actual lengths, so
   that a sequence gets back what rounding up had reserved.
4. *Best fit*: small lengths, longest first, go where the least room remains.

The plan is a list of intervals (length, first rank, count) -> (first sequence, offset). Its size
depends on ``max_len`` and ``groups`` only, so it is broadcast.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_worker, saved

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """``text -> list of ids`` for a byte-level BPE file of the tokenizers library.

    The file's own vocabulary is also given to tiktoken, which is about four times as fast and
    makes the same ids. It is used only if both agree on a probe, and not for texts with a
    special token's string or a very long run without white space.
    """
    return per_worker(f"encoder {path}", lambda: _load(path))


def _load(path: str):
    import json
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model.get("added_tokens", [])]
    letters = _byte_alphabet()
    try:
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "It's 12,345 tests\n\n  of élève 中文 \U0001f600!! don't\t x  "
        same = fast.encode_ordinary(probe) == plain(probe)
    except (KeyError, ValueError):  # not a byte-level vocabulary
        return plain
    odd = re.compile("|".join([re.escape(s) for s in special] + [r"\S{2000}", r"\s{2000}"]))
    return (lambda text: plain(text) if odd.search(text) else fast.encode_ordinary(text)) if same else plain


def token_pieces(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut what is longer than ``max_len``.

    A document's ids are those of its text (NULL: empty) and ``end_id``. Only longer ones are
    cut; the first piece takes the remainder, all others are full. One row per piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [end_id], dtype="<u4")
                first = (len(ids) - 1) % max_len + 1
                edges = [0, *range(first, len(ids) + 1, max_len)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for col, v in zip(rows, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def _fullest(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[int]:
    """Counts of a configuration: the fullest that the demand allows and, among those, one with the
    largest sizes. It starts with the largest size in demand, so that hard sizes go first."""
    first = int(np.flatnonzero(demand)[0])
    room = capacity - int(sizes[first])
    count = [0] * len(sizes)
    count[first] = 1
    left = demand.copy()
    left[first] -= 1
    # reach[i]: totals that sizes[i:] can make; built from the smallest size up
    live = [i for i in range(len(sizes)) if left[i] > 0 and sizes[i] <= room]
    reach = {len(live): np.eye(1, room + 1, dtype=bool)[0]}
    for p in range(len(live) - 1, -1, -1):
        s, most = int(sizes[live[p]]), int(min(left[live[p]], room // sizes[live[p]]))
        r = reach[p + 1]
        out = r.copy()
        for m in range(1, most + 1):
            out[m * s:] |= r[: room + 1 - m * s]
        reach[p] = out
    total = int(np.flatnonzero(reach[0])[-1])
    for p, i in enumerate(live):
        s = int(sizes[i])
        for m in range(int(min(left[i], total // s)), -1, -1):
            if reach[p + 1][total - m * s]:
                count[i] += m
                total -= m * s
                break
    return count


def plan(counts: dict[int, int], capacity: int = 1024, groups: int = 256, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, count, first sequence, offset) that place every piece.

    ``counts`` has the number of pieces of each length. Lengths of at most ``small`` (default: an
    eighth of the capacity) are left to best fit.
    """
    small = capacity // 8 if small is None else small
    large = sorted((n for n in counts if n > small and counts[n] > 0), reverse=True)
    whole = sum(counts[n] for n in large)
    # linear grouping: equal cardinality, each rounded up to its largest length
    queues: list[list[list[int]]] = []  # per group runs [length, first rank, count], longest first
    share, filled = max(1, -(-whole // groups)), 0
    for n in large:
        rank, left = 0, counts[n]
        while left:
            if not queues or filled == share:
                queues.append([])
                filled = 0
            take = min(left, share - filled)
            queues[-1].append([n, rank, take])
            rank, left, filled = rank + take, left - take, filled + take
    sizes = np.array([q[0][0] for q in queues], dtype=np.int64)
    demand = np.array([sum(r[2] for r in q) for q in queues], dtype=np.int64)
    for q in queues:
        q.reverse()  # popped from the end, longest first
    out: list[tuple[int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, count)
    sequence = 0
    while demand.any():
        config = _fullest(sizes, demand, capacity)
        used = [i for i, c in enumerate(config) if c]
        times = min(int(demand[i]) // config[i] for i in used)
        for i in used:
            demand[i] -= times * config[i]
        # substitution: one run of actual lengths per slot, cut where any slot's run ends
        slots = []
        for i in used:
            for _ in range(config[i]):
                need, runs = times, []
                while need:
                    run = queues[i][-1]
                    take = min(need, run[2])
                    runs.append([run[0], run[1], take])
                    run[1], run[2], need = run[1] + take, run[2] - take, need - take
                    if not run[2]:
                        queues[i].pop()
                slots.append(runs[::-1])
        done = 0
        while done < times:
            step, offset = min(s[-1][2] for s in slots), 0
            for s in slots:
                run = s[-1]
                out.append((run[0], run[1], step, sequence, offset))
                offset += run[0]
                run[1], run[2] = run[1] + step, run[2] - step
                if not run[2]:
                    s.pop()
            bins[capacity - offset].append((sequence, step))
            sequence, done = sequence + step, done + step
    # best fit, longest first
    rooms = sorted(bins)
    for n in sorted((n for n in counts if n <= small and counts[n] > 0), reverse=True):
        rank, left = 0, counts[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                fresh = min(left, -(-left // (capacity // n)))
                bins[capacity].append((sequence, fresh))
                bisect.insort(rooms, capacity)
                sequence += fresh
                continue
            room = rooms[at]
            first, many = bins[room].pop()
            take = min(many, left)
            if take < many:
                bins[room].append((first + take, many - take))
            if not bins[room]:
                rooms.pop(at)
            out.append((n, rank, take, first, capacity - room))
            if room > n:
                if not bins[room - n]:
                    bisect.insort(rooms, room - n)
                bins[room - n].append((first, take))
            rank, left = rank + take, left - take
    return out


def best_plan(counts: dict[int, int], capacity: int = 1024, groups: int = 256) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences over several limits of what counts as small."""
    plans = [plan(counts, capacity, groups, capacity * k // 16) for k in (2, 4, 5, 6, 8)]
    return min(plans, key=lambda rows: max((s + c for _, _, c, s, _ in rows), default=0))


def merge_plan(rows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Join neighbouring intervals of a plan that continue each other."""
    out: list[tuple[int, int, int, int, int]] = []
    for n, r, c, s, o in heapq.merge(sorted(rows)):
        if out and (p := out[-1])[0] == n and p[1] + p[2] == r and p[3] + p[2] == s and p[4] == o:
            out[-1] = (n, p[1], p[2] + c, p[3], o)
        else:
            out.append((n, r, c, s, o))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = 1024, end_id: int = 2,
         groups: int = 256, rows_per_bucket: int = 100_000) -> DataFrame:
    """Pack all documents into sequences of at most ``max_len`` tokens.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. NULL and empty texts
    are one piece of length 1 (the end id). Rows with a NULL doc_id and repeated rows are packed
    like any other, one by one. An empty table gives no rows. Other columns of ``docs`` are not
    read.
    """
    import public_tokenizers

    spark = docs.sparkSession
    pieces = saved(token_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), max_len, end_id), "pieces")
    # at most max_len rows, whatever the corpus size
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    places = spark.createDataFrame(merge_plan(best_plan(counts, max_len, groups)) or [(0, 0, 0, 0, 0)],
                                   "length bigint, first bigint, many bigint, seq0 bigint, offset bigint")
    # rank within a length: position in a hash bucket plus the sizes of the buckets before it
    buckets = max(64, -(-total // rows_per_bucket))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (pieces.withColumn("at", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("at")))
    p = F.broadcast(places).alias("p")
    r = ranked.alias("r")
    inside = (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.first") + F.col("p.many"))
    return r.join(p, inside).select(
        "r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32",
        (F.col("p.seq0") + F.col("r.rank") - F.col("p.first")).alias("sequence_id"), F.col("p.offset").alias("offset"))
