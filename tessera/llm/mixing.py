"""Mixing sources to target weights by pivotal dependent rounding (dealt operator 10).

Each document of a source should be taken ``target / source size`` times. The whole part is taken
as it is; the fractional parts are rounded by the pivotal method, with mass measured in words: a
document goes up or down at random, by its own probability, and the documents after it in order of size
give or take the words, so that a source's words stay the same. Rows that are wholly alike are one entry
with a number, of which at most one is left fractional.

The longest come first, and the shortest few of each chunk are left fractional: with what else remains
fractional they are paired again on the next level of a reduction tree (``FAN`` chunks to one), where
they are the small change for what is long. At the root one document per source is left, which goes to
the nearer side.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, saved

WEIGHTS = (5, 2, 1)
CHUNK = 4000
FAN = 64
STATE = "doc_id bigint, source string, size bigint, n bigint, base int, more bigint, part double, chunk bigint"
#: Documents of a source that a chunk leaves as small change, and rows that are made of a kind at a time.
CHANGE = 8
PIECE = 10_000
#: A source table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from the documents' (source, size).

    Sources are ordered by code point, NULL last, and weigh ``weights`` in turn. Targets add up to
    ``share`` of all sizes; none exceeds ``cap`` times its source's size, and what is above is
    shared again by weight until none is above. Each round is one aggregate over the source table.
    """
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    every = [float(w) for w in weights]
    rows = saved(spark.createDataFrame(ordered.map(lambda x: (x[0][0], x[0][1], every[x[1] % len(every)])),
                                       "source string, source_size bigint, weight double"), "sources")
    top = F.col("source_size") * F.lit(float(cap))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        above = top < F.col("weight") * F.lit(level)
        held, free = rows.agg(F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        following = (share * total - (held or 0.0)) / free
        if following <= level:
            break
        level = following
    return rows.select("source", "source_size", F.least(top, F.col("weight") * F.lit(level)).alias("target"))


def _pivot(size: list[int], part: list[float], draw) -> list[float]:
    """Round the parts of documents in order; at most one stays fractional.

    A document that can reach one side only with the words of those after it goes to that side."""
    out = list(part)
    open_ = [i for i, x in enumerate(out) if 0.0 < x < 1.0]
    give = sum(size[i] * out[i] for i in open_)  # words that the documents from here on have taken
    room = sum(size[i] * (1 - out[i]) for i in open_)  # and those that they lack
    at, up = -1, False
    for i in open_:
        give -= size[i] * out[i]
        room -= size[i] * (1 - out[i])
        while 0.0 < out[i] < 1.0:
            if at < 0:
                at = i
                can_up, can_down = give >= size[i] * (1 - out[i]), room >= size[i] * out[i]
                up = can_up if can_up != can_down else bool(draw() < out[i])
                break
            need = size[at] * (1 - out[at]) if up else size[at] * out[at]
            have = size[i] * out[i] if up else size[i] * (1 - out[i])
            moved = min(need, have) if up else -min(need, have)
            # the one that reaches its bound is set to it, free of rounding errors
            out[at] = (1.0 if up else 0.0) if need <= have else min(1.0, max(0.0, out[at] + moved / size[at]))
            out[i] = (0.0 if up else 1.0) if have <= need else min(1.0, max(0.0, out[i] - moved / size[i]))
            if not 0.0 < out[at] < 1.0:
                at = -1
    return out


def _rounder(level: int, seed: int, root: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "size", "doc_id", "part"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(rows["chunk"].iloc[0])])
        name = rows["source"]
        new = (name != name.shift()) & ~(name.isna() & name.shift().isna())
        part: list[float] = []
        for _, g in rows.groupby(new.cumsum(), sort=False):
            own = g["part"].to_numpy()
            last = np.flatnonzero((own > 0) & (own < 1))[-CHANGE:]
            cut = len(own) if root else last[0] if len(last) else 0
            got = _pivot(g["size"].tolist()[:cut], own.tolist()[:cut], rng.random) + own.tolist()[cut:]
            part += [float(x >= 0.5) if root else x for x in got]
        rows["part"] = part
        return rows

    return run


def copies(sized: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Whole numbers of copies for documents (doc_id, source, size) of sources with targets: one row for
    each kind of row, with ``n`` rows of it, of which the first ``more`` are taken once more than ``base``
    times."""
    few = targets.count() <= BROADCAST_SOURCES
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    kinds = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    share = F.when(F.col("d.size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)) * F.col("d.n")
    state = (kinds.alias("d").join((F.broadcast(targets) if few else targets).alias("t"), same)
             .select("d.doc_id", "d.source", "d.size", "d.n", F.floor(rate).cast("int").alias("base"), F.floor(share).cast("bigint").alias("more"),
                     (share - F.floor(share)).alias("part")))
    state = saved(state, "kinds")
    chunks = max(1, -(-state.count() // CHUNK))
    state = state.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "source"), F.lit(chunks)))
    state = saved(state.groupBy("chunk").applyInPandas(_rounder(0, seed, chunks == 1), STATE), "mix0")
    done, level = [], 0
    while chunks > 1:
        level += 1
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(state.filter(~open_))
        chunks = -(-chunks // FAN)
        up = state.filter(open_).withColumn("chunk", F.floor(F.col("chunk") / FAN))
        state = saved(up.groupBy("source", "chunk").applyInPandas(_rounder(level, seed, chunks == 1), STATE), f"mix{level}")
    for rows in done:
        state = state.unionByName(rows)
    return state.select("doc_id", "source", "size", "n", "base", (F.col("more") + F.col("part").cast("bigint")).alias("more"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    A document's size is its number of words (NULL and blank texts: 0; they are taken as often as
    the whole part of their source's rate, which adds no words). ``taken`` is copies times size,
    never above ``cap`` times the size. NULL sources are one source, the last. Rows of equal id, source
    and size are one kind, of which as many are taken once more as their common share says. An empty table gives no rows.
    Other columns are not read. The same input and seed give the same result.
    """
    sized = saved(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized, share, cap, weights)
    few = targets.count() <= BROADCAST_SOURCES
    got = copies(sized, targets, seed)
    t = (F.broadcast(targets) if few else targets).alias("t")
    rows = (got.alias("d").join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
            .select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "d.n", "d.base", "d.more"))
    # a kind with very many rows is spread before its rows are made
    rows = rows.withColumn("p", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})"))).repartition("doc_id", "size", "p")
    rows = rows.withColumn("i", F.explode(F.expr(f"sequence(p * {PIECE} + 1, least(n, (p + 1) * {PIECE}))")))
    rows = rows.withColumn("copies", F.col("base") + (F.col("i") <= F.col("more")).cast("int"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source and others) as often as taken.

    Rows of equal id, source and size share their copies by chance. NULL texts and blank ones stay as
    often as the whole part of their source's rate; NULL sources are one source; an empty table gives no
    rows. All columns stay."""
    sized = saved(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")
    got = copies(sized, source_targets(sized, share, cap, weights), seed).select("doc_id", "source", "size", "n", "base", "more")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    rows = rows.select("r", count_words(F.col("r.text")).alias("words"))
    key = (F.col("a.r.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.r.source").eqNullSafe(F.col("b.source")) & (F.col("a.words") == F.col("b.size")))
    # only kinds of several rows that aren't all taken equally often need a number
    alike = (F.col("more") == 0) | (F.col("more") == F.col("n"))
    both = rows.alias("a").join(got.alias("b"), key)
    plain = both.filter(alike).select("r", (F.col("base") + (F.col("more") > 0).cast("int")).alias("copies"))
    order = Window.partitionBy("b.doc_id", "b.source", "b.size").orderBy(F.md5("a.r.text"))
    some = both.filter(~alike).withColumn("i", F.row_number().over(order)).select("r", (F.col("base") + (F.col("i") <= F.col("more")).cast("int")).alias("copies"))
    every = plain.unionByName(some).filter("copies > 0").select("r", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return every.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
