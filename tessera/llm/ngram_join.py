"""N-gram Jaccard self-join by MinHash banding (dealt operator 9).

1. Equal texts are one *text* with a number of copies; only texts are compared.
2. MinHash signatures; the numbers of bands and of rows per band are chosen for the target recall.
   Texts with an equal band meet by a shuffle on the band's hash. A band that many texts share is
   cut into blocks, and blocks meet in pairs, so no task gathers it whole.
3. Texts that meet are linked tentatively if their signatures agree in ``PLAUSIBLE`` of their rows,
   far below the threshold. Per block only a spanning forest of such links goes out. Their
   components are the *neighbourhoods*: all links lie within one.
4. Each text's full n-gram set is sent to its neighbourhood once, blocks of a large one in pairs
   again, and all pairs in it are verified exactly. Counts of links and a spanning forest go out,
   never the pairs themselves.
5. The components of the verified links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .common import count_words, discard, saved
from .graph import components

#: Rows of a signature that are compared before sets are, and the least share that must agree.
ROWS = 48
PLAUSIBLE = 0.55
#: Texts of one block, and n-grams of one, about (a longer text is a block by itself).
BLOCK = 256
BLOCK_GRAMS = 1 << 20


def bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows) with at most ``most`` hashes: the most rows, so the fewest chance meetings,
    for which a pair at the threshold meets with probability ``recall``."""
    best = None
    for r in range(1, most + 1):
        p = threshold ** r
        b = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if b * r <= most:
            best = (b, r)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some texts, all in a row, and where each text's end. A text of
    fewer than n words has one, of all its words; a text without words has none."""
    units, ends = winnow.word_units(texts)
    h = winnow.Hashes(units)
    size = np.diff(ends, prepend=0)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    stops = np.cumsum(count)
    first = np.repeat(ends - size - (stops - count), count) + np.arange(count.sum())
    return h.runs(first, np.minimum(first + n, np.repeat(ends, count))), stops


def signatures(grams: np.ndarray, stops: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values of each text; of texts without n-grams they mean nothing."""
    rng = np.random.default_rng(2024)
    odd = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    size = np.diff(stops, prepend=0)
    some = size > 0
    out = np.zeros((len(stops), k), np.uint32)
    if some.any():
        x = (grams >> np.uint64(32)).astype(np.uint32)
        begin = (stops - size)[some]
        for i in range(k):
            out[some, i] = np.minimum.reduceat((x ^ flip[i]) * odd[i], begin)
    return out


def _signed(n: int, b: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            every = batch.column(1).cast(pa.binary()).to_pylist()
            for first, texts in winnow.batches(every):
                grams, stops = shingles(texts, n)
                s = signatures(grams, stops, b * r)
                hashes = np.stack([winnow.Hashes(s[:, i * r:(i + 1) * r].astype(np.uint64).ravel()).runs(
                    np.arange(len(texts)) * r, np.arange(1, len(texts) + 1) * r) + np.uint64(i) for i in range(b)], 1)
                hashes = winnow.mix(hashes).view(np.int64)
                short = np.ascontiguousarray(s[:, :ROWS] >> np.uint32(3)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, len(texts)), pa.array(list(hashes), pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())],
                    ["t", "bands", "sig"])

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a graph given as a matrix: each vertex and the least of its component."""
    n = len(linked)
    label = np.arange(n)
    for i in range(n):
        if label[i] != i:
            continue
        front = np.zeros(n, bool)
        front[i] = True
        inside = front.copy()
        while front.any():
            front = linked[front].any(0) & ~inside
            inside |= front
        label[inside] = i
    return [(i, int(x)) for i, x in enumerate(label) if x != i]


def _column(c: pa.Array) -> list:
    """Values of a column; lists of numbers as arrays, without Python numbers."""
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    ends, values = c.offsets.to_numpy(), c.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(_column(c) for c in batch.columns)):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[bytes, bytes]] = []
    for _, rows in _groups(batches, 3):
        if len(rows) > 1:
            sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
            agree = np.stack([(sig == row).mean(1, dtype=np.float32) for row in sig])
            out += [(rows[i][0], rows[j][0]) for i, j in _forest(agree >= PLAUSIBLE)]
        if len(out) >= 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _blocked(rows: DataFrame, n: str) -> DataFrame:
    """Copies of rows for each pair of the ``n`` blocks of their group: bi <= bj. A group of one block
    has one pair, of the block with itself."""
    rows = rows.withColumn("_g", F.col(n).cast("int")).withColumn("_b", F.pmod(F.xxhash64("t", F.lit(5)), F.col("_g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    return (rows.withColumn("_o", other).withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
            .withColumn("mine", F.col("_b")).drop("_g", "_b", "_o", n))


def _verify(threshold: float):
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, bi, bj), rows in _groups(batches, 3):
            # rows: t, block, copies, n-grams
            sets = [r[3] for r in rows]
            size = np.array([len(x) for x in sets])
            of = np.repeat(np.arange(len(rows)), size)
            grams = np.concatenate(sets)
            order = np.argsort(grams, kind="stable")
            grams, of = grams[order], of[order]
            cut = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            stop = np.append(cut[1:], len(grams))
            common = np.zeros((len(rows), len(rows)), np.int32)
            twice = stop - cut == 2
            np.add.at(common, (of[cut[twice]], of[cut[twice] + 1]), 1)
            np.add.at(common, (of[cut[twice] + 1], of[cut[twice]]), 1)
            for a, b in zip(cut[stop - cut > 2], stop[stop - cut > 2]):
                common[np.ix_(of[a:b], of[a:b])] += 1
            union = size[:, None] + size[None, :] - common
            linked = common >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            block = np.array([r[1] for r in rows])
            if bi != bj:  # pairs within a block are counted where the block meets itself
                linked &= block[:, None] != block[None, :]
            copies = np.array([r[2] for r in rows])
            texts = linked.sum(1)
            docs = linked @ copies
            out += [(rows[i][0], None, int(texts[i]), int(docs[i])) for i in np.flatnonzero(texts)]
            out += [(rows[i][0], rows[j][0], 0, 0) for i, j in _forest(linked)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["t", "root", "texts", "docs"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["t", "root", "texts", "docs"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.select([c for c in batch.schema.names if c != "text"])
            every = batch.column("text").cast(pa.binary()).to_pylist()
            for first, texts in winnow.batches(every):
                grams, stops = shingles(texts, n)
                lists = [np.unique(x.view(np.int64)) for x in np.split(grams, stops[:-1])]
                part = keep.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int64()))], [*part.schema.names, "grams"])

    return run


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, some, t: hash of the text) and texts (t, copies, least doc_id, root of its
    class, texts and docs: numbers of links)."""
    b, r = bands(threshold, recall)
    rows = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("t"), count_words(F.col("text")).alias("words"))
    rows = rows.withColumn("some", F.col("words") > 0)
    members = saved(rows.select("doc_id", "some", "t", "words"), "members")
    texts = saved(members.filter("some").groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"),
                                                          F.first("words").alias("words")), "texts")
    members = members.drop("words")
    signed = saved(rows.filter("some").select("t", "text").mapInArrow(_signed(n, b, r), "t binary, bands array<bigint>, sig binary")
                   .dropDuplicates(["t"]), "signatures")
    met = signed.select("t", F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = met.withColumn("n", F.ceil(F.col("n") / BLOCK))
    meeting = signed.select("t", "sig", F.explode("bands").alias("band")).join(met, "band")
    near = saved(_blocked(meeting, "n").select("band", "bi", "bj", "t", "sig").repartition("band", "bi", "bj")
                 .sortWithinPartitions("band", "bi", "bj").mapInArrow(_meet, "a binary, b binary"), "meetings")
    discard(signed)
    hoods = components(near)
    discard(near)
    hoods = hoods.join(texts, F.col("v") == F.col("t"))
    sizes = hoods.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("words") / BLOCK_GRAMS)).alias("n"))
    # one row per text of a neighbourhood: its document with the least id, so that copies of a text
    # neither meet in one task nor are shuffled on; rows that are wholly repeated are in one partition
    wanted = (hoods.join(sizes, "root")
              .select("t", F.coalesce("least", F.lit(-(1 << 63))).alias("d"), "root", "n", "copies"))
    with_text = (rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "t", "text").join(wanted, ["d", "t"])
                 .dropDuplicates(["d", "t"]).select("t", "root", "n", "copies", "text")
                 .mapInArrow(_sets(n), "t binary, root binary, n bigint, copies bigint, grams array<bigint>"))
    found = saved(_blocked(with_text, "n").select("root", "bi", "bj", "t", "mine", "copies", "grams")
                  .repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
                  .mapInArrow(_verify(threshold), "t binary, root binary, texts bigint, docs bigint"), "verified")
    links = found.filter("root IS NULL").groupBy("t").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = components(found.filter("root IS NOT NULL").select(F.col("t").alias("a"), F.col("root").alias("b")))
    return members, (texts.join(links, "t", "left").join(classes.withColumnRenamed("v", "t"), "t", "left")
                     .withColumn("root", F.coalesce("root", "t")))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``threshold`` on their word n-grams.

    Returns per row of ``docs`` (doc_id, text): doc_id, class_id (the least doc_id of the class),
    class_size (rows), n_links (other rows linked to this one: copies of its text and those of
    similarity at or above the threshold), n_text_links (different texts among them). Classes are
    the connected components of the links. Words are runs of characters that aren't ASCII white
    space, unchanged. A text of fewer than n words has one n-gram, of all its words. NULL texts and
    those without words have no links; each such row is a class of its own, as is any row without
    links. A class whose ids are all NULL has the id NULL. Repeated rows are copies. A pair at the
    threshold is found with probability ``recall`` or more, one well above it practically always;
    all pairs found are verified on their full sets. An empty table gives no rows; other columns
    are not read.
    """
    members, per_text = _linked(docs, n, threshold, recall)
    per_class = per_text.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    per_text = saved(per_text.drop("words").join(per_class, "root").select(
        "t", "class_id", "class_size", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links")), "classes")
    got = members.filter("some").join(per_text, "t").drop("t", "some")
    alone = members.filter("NOT some").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                              F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return got.select(alone.columns).unionByName(alone)


def one_per_class(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others), unchanged, that stand for their class: the
    one with the least doc_id (see ``near_duplicates``). Rows without words all stay."""
    members, per_text = _linked(docs, n, threshold, recall)
    best = per_text.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "t")).alias("k")).select("k.least", "k.t")
    best = saved(best.select(F.coalesce("least", F.lit(-(1 << 63))).alias("d"), "t"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    rows = rows.select("r", F.coalesce(F.col("r.doc_id"), F.lit(-(1 << 63))).alias("d"), F.unhex(F.md5("r.text")).alias("t"),
                       (count_words(F.col("r.text")) > 0).alias("some"))
    kept = rows.filter("some").drop("some").join(best, ["d", "t"]).dropDuplicates(["d", "t"]).select("r")
    kept = kept.unionByName(rows.filter("NOT some").select("r"))
    return kept.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
