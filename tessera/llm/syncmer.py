"""Document fingerprints by closed syncmers (dealt operator 7).

DataFrame and SQL functions only. The units are words. Of a text's runs of ``K`` words, those are
chosen whose least run of ``S`` words (by hash) is their first or last: a choice that depends on
the run alone, so an edit changes only the runs that it touches, and two texts choose the same runs
of what they share. The fingerprint has all chosen runs (*anchors*) with their places. Two texts are
compared by the anchors that match in place: a shared passage moves as a whole, so each of its
anchors is followed by the same one at the same distance, wherever it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, saved, words_of

K, S = 5, 2
_PLACE = (1 << 32) - 1


def sketch(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: all anchors (closed syncmers) of column ``text`` in order, each a long of its
    hash (upper half) and the place of its first word (lower half). A text that has no closed
    syncmer (always below K words, at times with 5 or 6) has one anchor, of all its words; one
    without words has none."""
    inner = K - S + 1
    rows = rows.withColumn("_w", words_of(F.col(text)))
    w = F.col("_w")
    rows = rows.withColumn("_h", F.transform(w, lambda x, i: F.xxhash64(*[x if j == 0 else F.get(w, i + j) for j in range(S)])))
    h = F.col("_h")

    def anchor(hashed: Column, i: Column) -> Column:
        return F.shiftleft(hashed.cast("long"), 32).bitwiseOR(i.cast("long"))

    def closed(x: Column, i: Column) -> Column:
        least = F.least(*[x if j == 0 else F.get(h, i + j) for j in range(inner)])
        edge = (least == x) | (least == F.get(h, i + inner - 1))
        return F.when((i <= F.size(w) - K) & edge, anchor(F.hash(*[F.get(w, i + j) for j in range(K)]), i))

    chosen = F.filter(F.transform(h, closed), lambda x: x.isNotNull())
    short = F.when(F.size(w) > 0, F.array(anchor(F.hash(F.concat_ws(" ", w)), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return (rows.withColumn("_c", chosen).withColumn(out, F.when(F.size("_c") > 0, F.col("_c")).otherwise(short)).drop("_w", "_h", "_c"))


def as_text(anchors: Column) -> Column:
    """Sixteen hexadecimal digits per anchor: eight of its hash, eight of its place."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def links(rows: DataFrame, anchors: str, out: str) -> DataFrame:
    """Add ``out``: the set of hashes of each anchor with its successor and the distance of the two.
    A text of one anchor has the hash of that one alone."""
    a = F.col(anchors)

    def link(x: Column, i: Column) -> Column:
        # hash and place of the successor less the own place: its hash and the distance
        return F.xxhash64(F.shiftright(x, 32), F.get(a, i + 1) - x.bitwiseAND(F.lit(_PLACE)))

    every = F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), link)
    return rows.withColumn(out, F.array_distinct(every))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the links of two texts, that is of anchors that match in place: with the
    same next anchor at the same distance. 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (NULL: empty), n_chars and a row's key: d, th and, within equal rows, occ."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d, th = row_key(F.col("doc_id"), text)
    return docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), d.alias("d"), th.alias("th"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("occ", F.row_number().over(Window.partitionBy("d", "th").orderBy("n_chars")))


def followers(docs: DataFrame) -> DataFrame:
    """Each row's key and size with those of the row before it in descending order of doc_id.

    Keys only are sorted: in ranges, of which the table of last rows has one row each. The first
    row's predecessor is the last row."""
    light = _numbered(_rows(docs).select("d", "th", "n_chars"))
    ranged = saved(light.repartitionByRange(F.desc("d"), F.asc("th"), F.asc("occ")).withColumn("part", F.spark_partition_id()), "order")
    # within a range by lag; the last row of each range comes before the first of the next
    order = Window.partitionBy("part").orderBy(F.desc("d"), "th", "occ")
    me = F.struct("d", "th", "occ", "n_chars")
    last = ranged.groupBy("part").agg(F.max_by(me, F.struct(-F.col("d").cast("decimal(20,0)"), F.col("th"), F.col("occ"))).alias("last"))
    parts = Window.orderBy("part")  # one row per range
    before = last.select("part", F.lag("last").over(parts).alias("back"),
                         F.last("last").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    return (ranged.withColumn("prev", F.lag(me).over(order)).join(F.broadcast(before), "part")
            .select("d", "th", "occ", F.coalesce("prev", "back", "end").alias("prev")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text.

    Edited: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of
    the next document in descending order of doc_id; after the last comes the first. Rows with
    equal ids are ordered by a hash of the text; NULL ids come last; NULL texts are empty. The only
    row of a table is its own next. Returns doc_id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next, next_id, next_chars. An empty table gives no rows; other columns are not
    read. Texts are shuffled by key, and each once more to the document before it, which makes the
    next one's anchors there: they would take more room than the text. next_id and next_chars tell
    which document that is; with them, both sides of the last join read the same columns, so that
    Spark reuses the shuffle of the texts.
    """
    prev = followers(docs)
    rows = _numbered(_rows(docs)).alias("r").join(prev.alias("p"), (F.col("r.d") == F.col("p.d")) & (F.col("r.th") == F.col("p.th"))
                                                  & (F.col("r.occ") - F.col("p.occ") == 0)).select("r.*", "p.prev")
    given = rows.select(F.col("prev.d").alias("d"), F.col("prev.th").alias("th"), F.col("prev.occ").alias("occ"), F.col("text").alias("next"),
                        F.col("doc_id").alias("next_id"), F.col("n_chars").alias("next_chars"))
    both = (rows.drop("prev").alias("m").join(given.alias("g"), (F.col("m.d") == F.col("g.d")) & (F.col("m.th") == F.col("g.th"))
                                              & (F.col("m.occ") - F.col("g.occ") == 0))
            .select("m.doc_id", "m.n_chars", "m.text", "g.next", "g.next_id", "g.next_chars",
                    F.concat(F.expr("substring(m.text, 1, cast(m.n_chars - floor(m.n_chars / 2) as int))"),
                             F.expr("substring(g.next, 1, cast(floor(m.n_chars / 2) as int))")).alias("edited")))
    done = both
    for text in ("text", "edited", "next"):
        done = links(sketch(done, text, f"{text}_anchors"), f"{text}_anchors", f"{text}_links")
    return done.select("doc_id", "n_chars", "edited", as_text(F.col("text_anchors")).alias("fingerprint"),
                       as_text(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(F.col("text_links"), F.col("edited_links")).alias("near_edited"),
                       likeness(F.col("text_links"), F.col("next_links")).alias("near_next"), "next_id", "next_chars")
