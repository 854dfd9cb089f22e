"""Personal data by boosted trees over candidate spans (dealt operator 2).

DataFrame and SQL functions only; the trees are Spark's own gradient boosting.

1. *Base spans*: four strict patterns with validators; they always count.
2. *Generators* propose further spans, which may overlap: written-out or spaced e-mail addresses,
   whole runs of digits and, from each group of digits in them, the forms of a number (telephone
   numbers, 3-2-4, dates, groups of four), identifiers, keys and assigned secrets.
3. *Boosted trees* score each candidate by its format and by the words around it. They are trained
   on candidates of the corpus: the ones that a validator or a secret's own form confirms against
   the ones that contradict it.
4. *Calibration*: on all candidates kept out of training, the least score whose precision reaches
   ``PRECISION`` becomes the threshold. Candidates above it are added if they overlap no base span
   and no better candidate.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, saved

# FIXED VALUES: base patterns. Quantifiers are possessive and starts are anchored at the start of a
# run, which changes no match but keeps Java's matcher from recursion and from quadratic scans.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# FIXED VALUES: generators of candidates, with the kind that an accepted span gets.
GENERATORS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}+){1,8}+",
    "number": r"(?<![0-9A-Za-z])(?=[0-9() ./-]{7})\(?[0-9]++(?:[() ./-]++[0-9]++)*+",
    "dotted": r"(?<![0-9A-Za-z.])[0-9]{1,5}+(?:\.[0-9]{1,5}+){1,5}+",
    "key": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+",
    "secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']? {0,2}[:=] {0,2}[\"']?[^\s\"']{4,}+",
}

# FIXED VALUES: the forms of a number inside a run of digits and separators. Each is sought at each
# group of digits, so that spans of all forms and starts are judged on their own; they end on a
# digit. Their candidates are of the kind "number".
_GROUP = r"[ ./-]{1,2}[0-9]{2,8}"
FORMS = [
    r"\(?[2-9][0-9]{2}\)?[ ./-]{0,2}[0-9]{3}[ ./-][0-9]{4}(?![0-9])",  # telephone 3-3-4
    r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9])",  # 3-2-4
    r"[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",  # telephone 3-4
    r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}(?![0-9])",  # a date, which counts against
    r"[0-9]{7,}+",  # one group
    r"[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,7}(?![0-9])",  # groups of four
    *[r"\(?0[0-9]{1,4}\)?(?:%s){%d}(?![0-9])" % (_GROUP, k) for k in (1, 2, 3, 4)],  # telephone with area code
]
#: Kind of each generator's spans: those of GENERATORS, then of FORMS.
NAMES = [*GENERATORS, *["number"] * len(FORMS)]
#: A form at a group of digits: the match is the group, group 1 is the form.
STARTS = [r"(?<![0-9A-Za-z])(?=(%s))\(?[0-9]++" % form for form in FORMS]

# FIXED VALUES: words before a span that speak for personal data.
CUES = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|passport|password|passwd|pwd|secret|token|key|login|user|address|ip)\W{0,4}$"
CONTEXT = 24
#: A bound on the candidates that the trees are fitted on.
MAX_TRAINING = 20_000
PRECISION = 0.95


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _matches(rows: DataFrame, text: str, pattern: str, out: str, only: Column, ahead: bool = False) -> DataFrame:
    """Add ``out``: the matches of a pattern as (start, end, m); code points, end exclusive. With
    ``ahead``, m is group 1, which starts with the match and may be longer, so that spans overlap.

    Starts are sums of the lengths of matches and of what lies between them, taken in blocks of 64
    so that a text with very many matches isn't summed again for each.
    """
    none = F.array().cast("array<string>")
    rows = (rows.withColumn("_m", F.when(only, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
            .withColumn("_g", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none)))
    m, g = F.col("_m"), F.col("_g")
    rows = rows.withColumn("_l", F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(g, i))).cast("long")))
    rows = rows.withColumn("_s", F.when(F.size("_m") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(none) if ahead else m)
    size = F.lit(64)
    blocks = F.when(F.size("_l") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / size).cast("int")),
                                                  lambda b: _sum(F.slice("_l", b * size + 1, size)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_b", blocks)
    rows = rows.withColumn("_p", F.transform("_b", lambda x, i: F.when(i > 0, _sum(F.slice("_b", F.lit(1), i))).otherwise(F.lit(0).cast("long"))))

    def place(x: Column, i: Column) -> Column:
        b = F.floor(i / size).cast("int")
        inside = i - b * size
        before = F.get("_p", b) + F.when(inside > 0, _sum(F.slice("_l", b * size + 1, inside))).otherwise(F.lit(0).cast("long"))
        start = before + F.length(F.get(g, i))
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("m"))

    return rows.withColumn(out, F.transform("_s", place)).drop("_m", "_s", "_g", "_l", "_b", "_p")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        def part(p: Column) -> Column:
            s = F.regexp_replace(p, "^0+", "")
            return (F.length(s) <= 3) & (F.coalesce(F.expr("0") + F.when(F.length(s) <= 3, s).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", F.when((n >= 12) & (n <= 19), _digits(m)).otherwise(F.lit("1")))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _kept(kind: str, k: int) -> Column:
    good = F.filter(kind, lambda x: _valid(kind, x["m"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))


def _with_context(name: str, g: int) -> Column:
    def one(x: Column) -> Column:
        start, end = x["start"].cast("int"), x["end"].cast("int")
        return F.struct(F.lit(g).alias("g"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"),
                        F.substring(F.col("t"), F.greatest(F.lit(1), start + 1 - CONTEXT), F.least(F.lit(CONTEXT), start)).alias("before"),
                        F.substring(F.col("t"), end + 1, F.lit(CONTEXT)).alias("after"))

    return F.transform(name, one)


def spans(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each row of ``docs`` (doc_id, text).

    doc_id; d and th (see ``row_key``); base: sorted (start, k, end), k the
    place of the kind in ``KINDS``; cand: (g, start, end, m, before, after), g the generator.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d, th = row_key(F.col("doc_id"), t)
    rows = docs.select("doc_id", d.alias("d"), th.alias("th"), t.alias("t"))
    rows = rows.withColumn("_digit", F.col("t").rlike("[0-9]")).withColumn("_at", F.contains("t", F.lit("@")))
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        rows = _matches(rows, "t", pattern, kind, F.col("_at") if kind == "email" else F.col("_digit"))
        found.append(_kept(kind, k))
    rows = rows.withColumn("base", F.sort_array(F.concat(*found))).drop(*KINDS)
    proposed = []
    for g, pattern in enumerate([*GENERATORS.values(), *STARTS]):
        name = f"_g{g}"
        only = F.col("t").rlike(r"(?i)@|[(\[]at[)\]]") if g == 0 else F.lit(True) if g == 4 else F.col("_digit")
        rows = _matches(rows, "t", pattern, name, only, ahead=g >= len(GENERATORS))
        proposed.append(_with_context(name, g))
    return rows.select("doc_id", "d", "th", "base", F.concat(*proposed).alias("cand"))


def _features(c: DataFrame) -> tuple[DataFrame, list[str]]:
    m = F.col("m")
    n = F.greatest(F.length(m), F.lit(1))

    def count(pattern: str, text: Column = m) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("double")

    made = {
        **{f"g{g}": (F.col("g") == g).cast("double") for g in range(len(NAMES))},
        "length": n.cast("double"), "digits": count("[^0-9]+"), "digit_share": count("[^0-9]+") / n,
        "upper_share": count("[^A-Z]+") / n, "lower_share": count("[^a-z]+") / n, "separators": count("[^ ()./-]+"),
        "groups": F.size(F.split(m, r"[^0-9]+")).cast("double"), "dots": count("[^.]+"), "dashes": count("[^-]+"),
        "at": F.contains(m, F.lit("@")).cast("double"), "equals": m.rlike("[:=]").cast("double"),
        "hex": m.rlike("^[0-9a-f]+$").cast("double"), "mixed": m.rlike("^[0-9A-Z]+$").cast("double"),
        "longest_digits": F.array_max(F.transform(F.split(m, "[^0-9]+"), F.length)).cast("double"),
        "cue": F.col("before").rlike(CUES).cast("double"), "plus": F.col("before").rlike(r"\+ ?\(?[0-9]{0,3}\)? ?$").cast("double"),
        "letter_before": F.col("before").rlike(r"\p{L}$").cast("double"), "space_before": F.col("before").rlike(r"(?:^|\s)$").cast("double"),
        "digit_after": F.col("after").rlike("^[0-9]").cast("double"), "letter_after": F.col("after").rlike(r"^\p{L}").cast("double"),
        "digits_around": count("[^0-9]+", F.concat("before", "after")),
    }
    return c.select("*", *[v.alias(f"f_{k}") for k, v in made.items()]), [f"f_{k}" for k in made]


def _confirmed() -> Column:
    """Weak label of a candidate: 1 confirmed, 0 contradicted, NULL unknown."""
    m, n = F.col("m"), F.length(_digits(F.col("m")))
    number = (F.col("g") == 1) | (F.col("g") >= len(GENERATORS))
    own = (m.rlike("^AKIA[0-9A-Z]{16}$") | m.rlike("^(?:sk|pk|ghp|gho|xox[bp])[-_][0-9A-Za-z-]{16,}$") | m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
           | m.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
           | ((F.col("g") == 4) & m.rlike("[0-9]") & m.rlike("[A-Za-z]")) | (m.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,64}$") & F.col("before").rlike(CUES)))
    against = ((F.col("g") == 2) & (F.size(F.split(m, r"\.")) != 4)) | (number & (n < 7)) | (m.rlike(r"^(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}$")) \
        | ((F.col("g") == 3) & m.rlike("^[A-Za-z]+[-_/][A-Za-z]+[-_/]?[0-9]{1,3}$")) | ((number | (F.col("g") == 3)) & m.rlike("^[0-9() ./-]+$") & (n >= 12) & ~F.col("inside"))
    # a number that only touches a base span, or a part of one, says nothing
    part = F.col("inside") & number & ~F.col("whole")
    return F.when(part, F.lit(None).cast("double")).when(F.col("inside") | own, 1.0).when(against | ((F.col("g") == 2) & ~F.col("inside")), 0.0)


def training(known: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The labelled candidates with ``held`` (a third by a hash of the span), and those of the others
    that the trees are fitted on, about ``MAX_TRAINING`` of them."""
    known = saved(known.withColumn("held", F.pmod(F.xxhash64("m", F.lit(seed + 1)), F.lit(3)) == 0), "training")
    open_ = known.filter("NOT held")
    take = min(1.0, MAX_TRAINING / max(1, open_.count()))
    die = F.pmod(F.xxhash64("m", F.lit(seed)), F.lit(1_000_000))
    return known, open_.filter(die < int(take * 1_000_000))


def added(found: DataFrame, seed: int = 5) -> DataFrame:
    """The candidates that the trees accept: d, th, extra (sorted (start, g, end))."""
    c = found.filter(F.size("cand") > 0).select("d", "th", "base", F.explode("cand").alias("c")).select("d", "th", "base", "c.*")
    meets = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    # numbers begin behind the plus of a telephone number
    whole = F.exists("base", lambda b: (b["end"] == F.col("end")) & (F.col("start") - b["start"]).between(0, 2))
    c, names = _features(c.withColumn("inside", meets).withColumn("whole", whole))
    c = saved(c.withColumn("label", _confirmed()).drop("base", "before", "after"), "candidates")
    known = c.filter("label IS NOT NULL").dropDuplicates(["m", "label", *names])
    known, fitted = training(known, seed)
    counts = {r["label"]: r["n"] for r in fitted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    open_ = c.filter(~F.col("inside"))
    if not all(counts.get(y) for y in (0.0, 1.0)):
        # nothing to tell apart: what is confirmed counts
        open_ = open_.withColumn("score", F.coalesce("label", F.lit(0.0)))
        limit = 0.5
    else:
        vector = VectorAssembler(inputCols=names, outputCol="x")
        trees = GBTClassifier(featuresCol="x", labelCol="label", predictionCol="_y", maxIter=12, maxDepth=4, stepSize=0.3, seed=seed)
        model = trees.setProbabilityCol("_p").setRawPredictionCol("_r").fit(vector.transform(fitted.coalesce(2)))
        score = lambda rows: model.transform(vector.transform(rows)).withColumn("score", vector_to_array("_p")[1])
        # least of a hundred thresholds that is precise enough on all candidates held out
        grid = (score(known.filter("held")).groupBy(F.floor(F.col("score") * 100).alias("s")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect())
        limit, good, n = 1.0, 0.0, 0
        for r in sorted(grid, key=lambda r: -r["s"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n:
                limit = r["s"] / 100
        limit = max(0.5, limit)
        open_ = score(open_)
    # a candidate whose label contradicts it is never added
    taken = open_.filter((F.col("score") >= limit) & (F.coalesce("label", F.lit(1.0)) > 0))
    # what is confirmed goes before what is only scored, and a number before a key of digits alone
    digits = (F.col("g") == list(GENERATORS).index("key")) & F.col("m").rlike("^[0-9/-]+$")
    rank = F.col("score") + F.coalesce("label", F.lit(0.0)) - F.when(digits, 2.0).otherwise(0.0)
    per = taken.groupBy("d", "th").agg(F.collect_set(F.struct("start", "g", "end", rank.alias("score"))).alias("x"))
    better = lambda a, b: (b["start"] < a["end"]) & (a["start"] < b["end"]) & (
        (b["score"] > a["score"]) | ((b["score"] == a["score"]) & ((b["end"] - b["start"] > a["end"] - a["start"])
                                                                  | ((b["end"] - b["start"] == a["end"] - a["start"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["g"] < a["g"])))))))
    best = F.filter("x", lambda a: ~F.exists("x", lambda b: better(a, b)))
    return per.select("d", "th", F.sort_array(F.transform(best, lambda a: F.struct(a["start"], (a["g"] + len(KINDS)).alias("k"), a["end"]))).alias("extra"))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(n) for n in (*KINDS, *NAMES)])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def _count_of(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each row of ``docs`` (doc_id, text), one row per row.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans), base (their list as text), spans
    (all as text: kind:start:end by start, then kind; code points, end exclusive), found (all as an
    array of (start, k, end)), d and th (see ``row_key``). NULL texts are empty. Rows with equal id and text get equal spans. An empty
    table gives no rows; other columns are not read. Texts are read once and not shuffled.
    """
    found = saved(spans(docs), "spans")
    extra = added(found)
    f, e = found.drop("cand").alias("f"), extra.alias("e")
    rows = f.join(e, (F.col("f.d") == F.col("e.d")) & (F.col("f.th") == F.col("e.th")), "left").select("f.*", "e.extra")
    counts = [_count_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    rows = rows.withColumn("found", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")))))
    return rows.select("doc_id", *counts, _joined(F.col("base")).alias("base"), _joined(F.col("found")).alias("spans"), "found", "d", "th")


def redacted(text: Column, found: Column) -> Column:
    """A text with its spans replaced by their kinds in angle brackets; of overlapping spans the
    first counts, and what of a later one lies behind it goes too."""
    names = F.array(*[F.lit(f"<{n}>") for n in (*KINDS, *NAMES)])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, b: F.substring(text, a.cast("int") + 1, F.greatest(F.lit(0), (b - a).cast("int")))
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], piece(acc["at"], s["start"]), F.when(s["start"] >= acc["at"], F.get(names, s["k"])).otherwise(F.lit(""))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"))
    done = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; all columns stay, and ``n_chars``, if
    there is one, follows the text. NULL texts stay NULL."""
    # rows with spans only; how many there are is not bounded, so the plan is a shuffle at every size
    found = personal_data(docs).filter(F.size("found") > 0).select("d", "th", "found").dropDuplicates(["d", "th"]).hint("merge")
    text = F.coalesce(F.col("r.text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    d, th = row_key(F.col("r.doc_id"), text)
    rows = rows.withColumn("d", d).withColumn("th", th)
    rows = rows.join(found, ["d", "th"], "left")
    rows = rows.withColumn("clean", F.when(F.col("found").isNotNull(), redacted(F.col("r.text"), F.col("found"))).otherwise(F.col("r.text")))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return rows.select(*[new.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns])
