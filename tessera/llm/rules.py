"""Quality rules with distribution divergence from language references (dealt operator 6).

DataFrame and SQL functions only. A document's histogram of character classes and of common words
is compared with its language's by Jensen-Shannon distance (base 2, 0 to 1). The references are
gathered from the corpus itself by grouped aggregates: a common word is one that makes up at least
``COMMON`` of a language's words, so a language has at most 1 / COMMON of them. Words are compared by
32-bit hashes, of which a common word shares its own with next to no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, words_of

#: Least share of a language's words that a common word has.
COMMON = 1 / 400
MIN_WORDS = 50
#: Least number of words for a comparison of common words.
GUARD_WORDS = 100

# FIXED VALUES: character classes of the histogram, besides white space and the symbols of the base
# rules; what is in none of them (mostly lower-case letters) is the last class.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:'\"?!()-]", "beyond_ascii": "[^\\x00-\\x7F]"}
#: Bits of a packed number that hold a word's place.
PLACE = 28


def _sum(a: Column, zero: Column) -> Column:
    return F.aggregate(a, zero, lambda s, x: s + x)


def _term(p: Column, q: Column) -> Column:
    """What a cell with shares p and q adds to twice the divergence."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0)))


def measure(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, lang, the base counts, ``classes`` (characters per class),
    ``words`` (32-bit hashes of the different words) and ``times`` (their counts). NULL texts are empty.

    Three-word windows are packed as 36 bits of a hash and the place, and sorted as numbers.
    Neighbours with the same hash are compared word by word, so a chance collision counts nothing.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = (docs.select("doc_id", "lang", t.alias("t")).withColumn("_w", words_of(F.col("t"))).withColumn("_lines", lines)
            # what is neither white space nor a small letter of ASCII is little, and holds all classes
            .withColumn("_rare", F.regexp_replace("t", r"[a-z\x20\x09-\x0D]+", ""))
            .withColumn("n_symbols", F.regexp_count("_rare", F.lit("[#*$%&|<>]")).cast("long"))
            .withColumn("word_chars", F.aggregate("_w", F.lit(0).cast("long"), lambda s, x: s + F.length(x))))
    w = F.col("_w")
    rows = rows.withColumn("_win", F.slice(F.sort_array(F.transform(w, lambda x, i: F.when(
        i < F.size(w) - 2, F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), PLACE).bitwiseOR(i.cast("long")))
        .otherwise(F.lit((1 << 63) - 1)))), F.lit(1), F.greatest(F.lit(0), F.size(w) - 2)))
    v = F.col("_win")
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")

    def same(x: Column, y: Column) -> Column:
        words = [F.get(w, place(x) + k) == F.get(w, place(y) + k) for k in range(3)]
        return F.coalesce((F.shiftright(x, PLACE) == F.shiftright(y, PLACE)) & words[0] & words[1] & words[2], F.lit(False))

    rows = rows.withColumn("_at", F.sort_array(F.transform(
        F.filter(v, lambda x, j: same(x, F.get(v, j + 1)) | same(x, F.get(v, j - 1))), place)))
    at = F.col("_at")
    # each repeated window covers three words, less what the next one covers too
    covered = _sum(F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))), F.lit(0))
    # what a lambda refers to is a column of its own, or it would be computed for each element
    rows = rows.withColumn("_sorted", F.sort_array(F.transform(w, lambda x: F.hash(x))))
    a = F.col("_sorted")
    rows = rows.withColumn("_runs", F.filter(F.transform(a, lambda x, i: F.when((i > 0) & (x == F.get(a, i - 1)), F.lit(-1)).otherwise(i)), lambda i: i >= 0))
    words = F.transform("_runs", lambda i: F.get(a, i))
    times = F.transform("_runs", lambda i, j: F.coalesce(F.get(F.col("_runs"), j + 1), F.size(a)) - i)
    n, chars = F.size("_w").cast("long"), F.length("t").cast("long")
    classes = F.array(chars - F.col("word_chars"), F.col("n_symbols"), *[F.regexp_count("_rare", F.lit(p)).cast("long") for p in CLASSES.values()])
    return rows.select(
        "doc_id", "lang", n.alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), chars.alias("chars"), classes.alias("classes"),
        words.alias("words"), times.alias("times"))


def references(rows: DataFrame) -> DataFrame:
    """One row per language of measured rows: lang, cc (shares of the character classes, the rest
    last), common (hashes of its common words, at most 1 / ``COMMON``) and shares (theirs). Rows with
    empty text or NULL lang add nothing."""
    known = rows.filter(F.col("lang").isNotNull() & (F.col("chars") > 0))
    parts = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)]
    langs = known.groupBy("lang").agg(F.sum("chars").alias("n"), F.sum("n_words").alias("all"), *parts)
    each = F.array(*[F.col(f"c{i}") / F.col("n") for i in range(len(CLASSES) + 2)])
    rest = F.greatest(F.lit(0.0), 1 - _sum(F.col("cc"), F.lit(0.0)))
    langs = saved(langs.select("lang", "all", each.alias("cc")).withColumn("cc", F.concat("cc", F.array(rest))), "languages")
    words = known.select("lang", F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy("lang", F.col("x.words").alias("w")).agg(F.sum("x.times").alias("n"))
    words = words.join(langs.select("lang", "all"), "lang").filter(F.col("n") >= COMMON * F.col("all"))
    common = words.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("w", (F.col("n") / F.col("all")).alias("share")))).alias("x"))
    none = lambda c, kind: F.coalesce(F.col(f"x.{c}"), F.array().cast(kind))
    return saved(langs.join(common, "lang", "left").select("lang", "cc", none("w", "array<int>").alias("common"), none("share", "array<double>").alias("shares")), "references")


def quality_rules(docs: DataFrame, max_class: float = 0.25, max_common: float = 0.5) -> DataFrame:
    """Base counts, distances and verdict of each row of ``docs`` (doc_id, text, lang).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, common_distance. ``kept`` is false if the base rules fail or a distance
    is above its limit. Guards: distances are NULL, and don't reject, for NULL or empty texts and
    for a language without a reference; common words are compared from ``GUARD_WORDS`` words on.
    Repeated rows are judged one by one; an empty table gives no rows; other columns are not read.
    Texts are read once; references are made for all languages and joined.
    """
    rows = saved(measure(docs), "measured")
    # as large as there are languages: Spark broadcasts it if it is small
    rows = rows.join(references(rows), "lang", "left")
    zero, n, chars = F.lit(0.0), F.col("n_words"), F.col("chars")
    cells = F.concat("classes", F.array(chars - _sum(F.col("classes"), F.lit(0).cast("long"))))
    class_js = _sum(F.transform(cells, lambda c, i: _term(c / chars, F.get(F.col("cc"), i))), zero) / 2
    # words that the document lacks add their share of the reference; so does the rest of both
    at = lambda values, keys, w: F.get(values, (F.array_position(keys, w) - 1).cast("int"))
    shared = F.transform(F.array_intersect("words", "common"), lambda w: F.struct(
        (at(F.col("times"), F.col("words"), w) / n).alias("p"), at(F.col("shares"), F.col("common"), w).alias("q")))
    rows = rows.withColumn("_shared", shared).withColumn("_all", _sum(F.col("shares"), zero))
    p_sum = _sum(F.transform("_shared", lambda r: r["p"]), zero)
    q_sum = _sum(F.transform("_shared", lambda r: r["q"]), zero)
    common_js = (_sum(F.transform("_shared", lambda r: _term(r["p"], r["q"])), zero) + (F.col("_all") - q_sum)
                 + _term(F.greatest(zero, 1 - p_sum), F.greatest(zero, 1 - F.col("_all")))) / 2
    root = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    rows = (rows.withColumn("class_distance", F.when((chars > 0) & F.col("cc").isNotNull(), root(class_js)))
            .withColumn("common_distance", F.when((n >= GUARD_WORDS) & F.col("common").isNotNull(), root(common_js)))
            .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)))
    near = (F.coalesce(F.col("class_distance") <= max_class, F.lit(True)) & F.coalesce(F.col("common_distance") <= max_common, F.lit(True)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & near).alias("kept"), "class_distance", "common_distance")
