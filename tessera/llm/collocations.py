"""Phrase collocations from sharded FM-indexes over word ids (dealt operator 12).

A task cuts its documents into shards of one language. A shard's words get local ids, and the
Burrows-Wheeler transforms of the word sequence and of its reverse are stored: the shard's FM-index. Suffixes are sorted by their first ``longest`` words only, which is as deep as a phrase goes.

Phrases grow by one word a level, in turn to the right (through the transform of the reverse) and to the
left (through the other one). A phrase is a pair of intervals, one in each order; extending one narrows
the other by the number of smaller neighbours, so both directions stay open. The neighbours in an
interval are all extensions of the phrase with their counts.

Counts are summed over shards four times: of words, of pairs of frequent words, of triples of frequent
pairs, and of longer phrases whose adjacent triples are all frequent. Frequent pairs and triples go to the
shards as bitmaps of a fixed size; what they let through by chance is counted like the rest and found
infrequent. Before triples are counted one by one, the shards sum them by the cells of such a bitmap: only
triples in cells that are frequent become rows, and no frequent triple lies in another cell. Phrases are keyed by
their words' numbers in the whole language, so sums are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, saved

#: Words of a shard, beyond which it is closed; a shard ends with a document or, in a long one, with a piece.
SHARD = 1 << 22
#: Bits of a word's id in its shard; 20 more number a task's shards.
ID_BITS = 23
#: Symbols of a transform in one row of the index; a shard has as many rows as it takes.
PART = 1 << 18
#: Bytes of text that are cut into words at a time; the cut is made at the next end of a piece.
CHUNK = 1 << 20
#: Bits of the bitmaps of frequent pairs and triples (8 MB each), whatever their number.
BITS = 1 << 26
#: Cells of the bitmap that are summed at a time.
CELLS = 1 << 20
#: Places of a transform that are read and sorted at a time, about; a phrase is not cut.
PLACES = 1 << 19
#: First rounds of the ranking split each language this many ways.
SPREAD = 64
INDEX = "lang string, shard bigint, part int, words array<string>, counts array<int>, forward binary, backward binary"


def _separators() -> bytes:
    """Byte table: A-Z to a-z, the ends of pieces to a line feed, tab to a space."""
    t = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        t[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        t[c] = 10
    t[9] = 32
    return bytes(t)


def _chunks(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Words of a text with ``.`` (never part of a word) at the ends of pieces."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + CHUNK) + 1 or len(text)
        yield text[at:end].replace(b"\n", b" . ").split()
        at = end


def _order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (beyond the end: 0)."""
    bits = max(1, int(codes.max(initial=0)).bit_length())
    n = len(codes)
    padded = np.append(codes, np.zeros(depth, codes.dtype))
    rank, used, at = np.zeros(n, np.int64), 0, 0
    order = np.arange(n)
    while at < depth:
        take = min(depth - at, (63 - used) // bits)
        for i in range(at, at + take):
            rank <<= bits
            rank |= padded[i:i + n]
        at += take
        order = np.argsort(rank)
        if at < depth:  # ranks so far are numbered anew, to make room for more symbols
            inside = rank[order]
            rank[order] = np.cumsum(np.append(False, inside[1:] != inside[:-1]), dtype=np.int64)
            used = int(n).bit_length()
    return order


def _packed(symbols: np.ndarray) -> bytes:
    """Symbols as their number and compressed planes of bytes: neighbours of equal surroundings are alike."""
    planes = symbols.view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.int32(len(symbols)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    planes = np.frombuffer(pa.decompress(data.slice(4), 4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


def _index(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _separators()
        shard = TaskContext.get().partitionId() << 20
        open_: dict[str, tuple[defaultdict, list, list]] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal shard
            ids, parts, _ = open_.pop(lang)
            codes = np.concatenate([np.zeros(1, np.int32), *parts])
            counts = np.bincount(codes, minlength=len(ids)).astype(np.int32)
            words = pa.array(list(ids)[1:], pa.binary()).cast(pa.string())
            ids.clear()
            transforms = [x[_order(x, longest) - 1].astype(np.int32) for x in (codes, codes[::-1].copy())]
            cuts = range(0, len(codes), PART)
            n = len(cuts)
            lists = pa.array([0, *[len(words)] * n], pa.int32())  # the first row has the words
            cols = [pa.array([lang] * n), pa.array([shard] * n), pa.array(range(n), pa.int32()), pa.ListArray.from_arrays(lists, words),
                    pa.ListArray.from_arrays(lists, pa.array(counts[1:])),
                    *(pa.array([_packed(x[i:i + PART]) for i in cuts], pa.binary()) for x in transforms)]
            shard += 1
            return pa.RecordBatch.from_arrays(cols, ["lang", "shard", "part", "words", "counts", "forward", "backward"])

        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for words in _chunks(text.as_buffer().to_pybytes() if text.is_valid else b"", table):
                        if lang not in open_:
                            ids: defaultdict = defaultdict()
                            ids.default_factory = ids.__len__
                            ids[b"."]
                            open_[lang] = ids, [], [0]
                        ids, parts, size = open_[lang]
                        words.append(b".")
                        parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                        size[0] += len(words)
                        if size[0] >= SHARD:
                            yield close(lang)
                        elif sum(s[0] for _, _, s in open_.values()) >= 2 * SHARD:
                            yield close(max(open_, key=lambda x: open_[x][2][0]))
        for lang in list(open_):
            yield close(lang)

    return run


def index(docs: DataFrame, longest: int) -> DataFrame:
    """FM-indexes over the words of ``docs`` (lang, text): a few rows a shard, the first with its words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return saved(rows.mapInArrow(_index(longest), INDEX), "index")


def _bit(*words: np.ndarray) -> np.ndarray:
    """Place of neighbouring words in a bitmap."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.int64) % BITS


def _bitmap(phrases: DataFrame, names: list[str]) -> np.ndarray:
    """Bits of the phrases in the columns ``names``: at most BITS / 8 bytes reach the driver."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = _bit(*(c.to_numpy() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.int64(1) << (bit & 31))], ["cell", "bit"])

    cells = phrases.select(*names).mapInArrow(place, "cell bigint, bit bigint").groupBy("cell").agg(F.expr("bit_or(bit)").alias("bits"))
    got = cells.toPandas()
    out = np.zeros(BITS // 32, np.uint32)
    out[got["cell"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint32)
    return out


def _cells(shared: list, least: int):
    """Triples of a shard whose pairs are in the bitmap, summed by their cell: a row for each block of ``CELLS``
    cells, with those that have any and their counts (``least`` stands for more)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"block": [], "cells": [], "counts": []}
        if left.num_rows and right.num_rows:
            shard = _Shard(left, right)
            got = shard.phrases()
            for size in (2, 3):
                got = shard.extend(got, "forward" if size % 2 else "backward", tuple(b.value for b in shared), 3 - size)
            place = _bit(*shard.word[got["words"]].T)
            order = np.argsort(place)
            place = place[order]
            head = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
            counts = np.minimum(np.add.reduceat(got["n"][order], head), least).astype(np.int32) if len(head) else np.zeros(0, np.int32)
            place = place[head]
            block, first = np.unique(place // CELLS, return_index=True)
            for b, x, y in zip(block.tolist(), first, [*first[1:], len(place)]):
                rows["block"].append(b)
                rows["cells"].append(_packed((place[x:y] - b * CELLS).astype(np.int32)))
                rows["counts"].append(_packed(counts[x:y]))
        return pa.table([pa.array(rows["block"], pa.int32()), pa.array(rows["cells"], pa.binary()), pa.array(rows["counts"], pa.binary())], list(rows))

    return run


def _frequent_cells(sums: DataFrame, least: int) -> np.ndarray:
    """Bits of the cells whose counts add up to ``least``: at most BITS / 8 bytes reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = -1, np.zeros(CELLS, np.int64)

        def bits() -> pa.RecordBatch:
            cells = (total >= least).reshape(-1, 32)
            packed = np.packbits(cells, axis=1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["block", "bits"])

        for batch in batches:
            for i, b in enumerate(batch["block"].to_pylist()):
                if b != block:
                    if block >= 0:
                        yield bits()
                    block = b
                    total[:] = 0
                total[_unpacked(batch["cells"][i].as_buffer())] += _unpacked(batch["counts"][i].as_buffer())  # a cell once a row
        if block >= 0:
            yield bits()

    out = np.zeros(BITS // 32, np.uint32)
    for row in sums.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary").collect():
        out[row.block * (CELLS // 32):][:CELLS // 32] = np.frombuffer(row.bits, "<u4")
    return out


class _Shard:
    """A shard's index and the numbers of its frequent words."""

    def __init__(self, left: pa.Table, right: pa.Table):
        parts = np.argsort(right["part"].to_numpy())
        self.transforms = {c: np.concatenate([_unpacked(right[c][int(i)].as_buffer()) for i in parts])
                           for c in ("forward", "backward") if c in right.column_names}
        size = len(next(iter(self.transforms.values())))
        counts = right["counts"].combine_chunks().flatten().to_numpy()
        self.counts = np.append(size - counts.sum(dtype=np.int64), counts).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.word = np.full(len(self.counts), -1, np.int64)
        ids = left["id"].to_numpy().astype(np.int64)
        self.word[ids] = left["gid"].to_numpy()
        self.ids = np.sort(ids).astype(np.int32)
        self.leads: dict[str, np.ndarray] = {}

    def phrases(self) -> dict[str, np.ndarray]:
        """The frequent words, as phrases: their ids in the shard, count and intervals."""
        return {"words": self.ids[:, None], "n": self.counts[self.ids], "forward": self.first[self.ids], "backward": self.first[self.ids]}

    def lead(self, main: str) -> np.ndarray:
        """Where a word's k-th place in a transform leads: its first place in the order and k more."""
        if main not in self.leads:
            x = self.transforms[main]
            self.leads[main] = np.empty(len(x), np.int32)
            self.leads[main][np.argsort(x, kind="stable")] = np.arange(len(x), dtype=np.int32)
        return self.leads[main]

    def extend(self, p: dict[str, np.ndarray], main: str, bits: tuple[np.ndarray, ...] = (), left: int = 0) -> dict[str, np.ndarray]:
        """All extensions by a frequent word through a transform (backward: to the right). If ``bits`` are given,
        the new pair of words must be in the first bitmap, the new triple in the next. The extensions have the
        intervals that ``left`` further rounds need, which go through the two transforms in turn."""
        start = np.cumsum(p["n"]) - p["n"]
        cuts = [0, *np.flatnonzero(np.diff(start // PLACES)) + 1, len(start)]
        some = [self._extend({k: x[a:b] for k, x in p.items()}, main, bits, left) for a, b in zip(cuts, cuts[1:])]
        return {k: np.concatenate([x[k] for x in some]) for k in some[0]}

    def _extend(self, p: dict[str, np.ndarray], main: str, bits: tuple[np.ndarray, ...], left: int) -> dict[str, np.ndarray]:
        n, start = p["n"], p[main]
        before = np.cumsum(n) - n
        at = np.arange(n.sum(), dtype=np.int32) + np.repeat((start - before).astype(np.int32), n)
        key = np.repeat(np.arange(len(n)) << 32, n)
        key |= self.transforms[main][at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        node, new = key[head] >> 32, (key[head] & 0xFFFFFFFF).astype(np.int32)
        keep = self.word[new] >= 0
        for size_, cells in zip((1, 2), bits):
            if p["words"].shape[1] >= size_:
                head, size, node, new = head[keep], size[keep], node[keep], new[keep]
                beside, word = self.word[p["words"][node]], self.word[new]
                bit = _bit(*beside[:, -size_:].T, word) if main == "backward" else _bit(word, *beside[:, :size_].T)
                keep = (cells[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)) > 0
        head, size, node, new = head[keep], size[keep], node[keep], new[keep][:, None]
        old = p["words"][node]
        out = {"words": np.concatenate([old, new] if main == "backward" else [new, old], 1), "n": size}
        if left > 0:
            other = "backward" if main == "forward" else "forward"
            out[other] = (p[other][node] + head - before[node]).astype(np.int32)
        if left > 1:
            out[main] = self.lead(main)[at[order[head]]]
        return out


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of frequent words in a shard, with counts."""
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("w0", "w1", "n")})
    shard = _Shard(left, right)
    got = shard.extend(shard.phrases(), "backward")
    return pa.table({"w0": shard.word[got["words"][:, 0]], "w1": shard.word[got["words"][:, 1]], "n": got["n"]})


def _longer(shared: list, least: int, longest: int):
    """Phrases of ``least`` to ``longest`` words in a shard whose pairs (and triples) are in the bitmaps; -1
    stands for no word."""
    names = [f"w{i}" for i in range(longest)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            bits = tuple(b.value for b in shared)
            shard = _Shard(left, right)
            got = shard.phrases()
            for size in range(2, longest + 1):
                got = shard.extend(got, "forward" if size % 2 else "backward", bits, longest - size)
                if size >= least:
                    none = pa.array(np.full(len(got["n"]), -1))
                    found.append(pa.table([*(pa.array(shard.word[x]) for x in got["words"].T), *[none] * (longest - size), pa.array(got["n"])], [*names, "n"]))
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], pa.int64()) for c in [*names, "n"]})

    return run


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text; other columns are not read. A-Z become small letters; texts are cut into
    pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. A phrase of 2 to
    ``longest`` words is a candidate if it occurs a >= ``least`` times within pieces, overlaps counted. n is the number of
    words of the language; cut after its first k words, its parts occur l and r times, and
    floor(1000 a n / (l r)) is least at the cut that counts (ties: the smallest k). Candidates that lie
    inside a longer candidate with the same count are dropped: if any does, one that is longer by a
    single word does, since counts don't rise with length. Order: score, a (both descending), phrase (UTF-8 bytes).

    A NULL lang is ``und``, a NULL text is empty; texts without words add nothing; repeated rows count
    as often as they occur; an empty table gives no rows. Products are exact up to 38 digits;
    a piece has fewer than 8 million different words.
    """
    shards = index(docs, longest)
    vocabulary = shards.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("id", "x")).select(
        "lang", "shard", (F.col("id") + 1).alias("id"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    total = saved(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda t, x: t + x)).alias("n")), "totals")
    # a frequent word's number is its first place: unique, and the same for all shards
    same = Window.partitionBy("lang", "word")
    place = F.call_function("shiftleft", F.col("shard"), F.lit(ID_BITS)).bitwiseOR(F.col("id").cast("bigint"))
    places = vocabulary.withColumns({"a": F.sum("n").over(same), "place": place}).withColumn("gid", F.min("place").over(same))
    places = saved(places.filter(F.col("a") >= least).drop("n"), "places")
    known = places.filter("gid = place").select("lang", "word", "a", "gid")
    left = places.select("shard", "gid", "id").groupBy("shard")
    pairs = left.cogroup(shards.select("shard", "part", "counts", "backward").groupBy("shard")).applyInArrow(_pairs, "w0 bigint, w1 bigint, n bigint")
    pairs = saved(pairs.groupBy("w0", "w1").agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "pairs")
    found = known.select(F.array("gid").alias("words"), "a").unionByName(pairs.select(F.array("w0", "w1").alias("words"), "a"))
    bits, before = [], pairs
    share = docs.sparkSession.sparkContext.broadcast  # BITS / 8 bytes each
    for least_, most in ((3, 3), (4, longest)):
        if most > longest or least_ > longest:
            break
        names = [f"w{i}" for i in range(most)]
        bits.append(share(_bitmap(before, names[:least_ - 1])))
        indexed = left.cogroup(shards.select("shard", "part", "counts", "forward", "backward").groupBy("shard"))
        sieve = []
        if least_ == 3:
            sums = saved(indexed.applyInArrow(_cells(list(bits), least), "block int, cells binary, counts binary"), "cells")
            sieve.append(share(_frequent_cells(sums, least)))
            discard(sums)
        longer = indexed.applyInArrow(
            _longer([*bits, *sieve], least_, most), ", ".join(f"{c} bigint" for c in [*names, "n"]))
        before = saved(longer.groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "longer")
        found = found.unionByName(before.select(F.filter(F.array(*names), lambda w: w >= 0).alias("words"), "a"))
    discard(shards)
    return _ranked(found, known, total, top)


def _ranked(found: DataFrame, known: DataFrame, total: DataFrame, top: int) -> DataFrame:
    """Scores of the phrases (words, a) of two words and more and the first ones of each language."""
    longer = found.filter(F.size("words") > 2)
    inside = longer.select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "a").distinct()
    candidates = found.filter(F.size("words") > 1).join(inside, ["words", "a"], "left_anti")
    each = candidates.select("words", "a", F.posexplode("words").alias("i", "gid")).join(known.select("gid", "lang", "word"), "gid")
    candidates = each.groupBy("words", "a").agg(F.first("lang").alias("lang"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # at most ``longest`` rows
    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = (cuts.withColumns({"first": F.expr("slice(words, 1, k)"), "rest": F.expr("slice(words, k + 1, size(words) - k)")})
            .join(found.select(F.col("words").alias("first"), F.col("a").alias("l")), "first")
            .join(found.select(F.col("words").alias("rest"), F.col("a").alias("r")), "rest").join(total, "lang"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"over": (big("a") * big("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), "under": (big("l") * big("r")).cast("decimal(38,0)")})
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("x"))
    scored = scored.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order)).cast("long")).filter(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
