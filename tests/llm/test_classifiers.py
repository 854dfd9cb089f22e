"""Language identification, quality, rules and personal data."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .conftest import odd_rows
from tessera.llm.langid import held_out, identify, keep_identified, learn
from tessera.llm.pii import GENERATORS, KINDS, personal_data, redact
from tessera.llm.quality import classify
from tessera.llm.rules import quality_rules

SYLLABLES = {"aa": ["ba", "do", "ki", "lu", "sen"], "bb": ["sch", "ung", "eit", "ver", "zu"], "cc": ["éa", "çon", "eux", "ment", "è"]}


def language_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(60)), lang, "s"))
    return rows


def test_language_held_out_accuracy(spark, make):
    rows = language_rows(1)
    docs = make(rows)
    got = {r.doc_id: r for r in identify(docs, learn(docs.filter(~held_out(F.col("doc_id"))))).collect()}
    truth = {r[0]: r[2] for r in rows}
    test = [r.doc_id for r in docs.filter(held_out(F.col("doc_id"))).collect()]
    assert len(test) > 10 and all(got[i].lang_pred == truth[i] and got[i].score > 0.9 for i in test)


def test_language_spans_of_mixed_text(spark, make):
    docs = make(language_rows(2))
    model = learn(docs)
    text = " ".join(["badoki lusen doba kilu senba"] * 8 + ["verung schzu eitver ungsch"] * 10)
    (r,) = identify(make([(1, text, None, None)]), model).collect()
    assert r.spans == "aa:0:40,bb:40:80"
    assert r.lang_pred == "bb" and 0.4 < r.score < 0.7


def test_language_odd_rows(spark, make):
    model = learn(make(language_rows(3)))
    docs = make(odd_rows() + [(30, "123 ... !!", "aa", "s"), (31, "Ωμέγα и Кириллица", None, "s")])
    got = identify(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.lang_pred in {"und", *SYLLABLES} and 0 <= r.score <= 1
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {None, 2, 3, 4, 30}
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and not {2, 3, 4, 30} & {r.doc_id for r in kept.collect()}
    assert learn(make([])) is None and learn(make([(1, None, "aa", "s"), (2, "x", None, "s")])) is None
    assert [r.lang_pred for r in identify(make([(1, "abc", None, None)]), None).collect()] == ["und"]
    assert identify(make([]), model).count() == 0


def test_quality_separates_and_shrinks(spark, make):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        text = " ".join(words) if good else " ".join(f"{w.upper()}###" for w in words)
        rows.append((i, text, "en", f"h{i % 7}"))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = make(rows).withColumn("host", F.col("source")).withColumn("path", F.col("lang"))
    got = {r.doc_id: r for r in classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    truth = {r[0]: "###" not in r[1] for r in rows}
    assert all(got[i].kept == truth[i] for i in truth)  # half of them unlabelled
    assert max(r.host_posterior for r in got.values()) - min(r.host_posterior for r in got.values()) < 0.3


def test_quality_odd_rows(spark, make):
    docs = make(odd_rows()).withColumn("host", F.col("source")).withColumn("path", F.col("lang"))
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for labels in (empty, spark.createDataFrame([(1, 1, 0), (1, None, 0), (9, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")):
        got = classify(docs, labels).collect()
        assert len(got) == docs.count() and all(0 < r.score < 1 for r in got)
    assert classify(docs.limit(0), empty).count() == 0


def rules_brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(zip(w, w[1:], w[2:]))
    twice = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice),
            len(w) < 50 or 100 * len(twice) > 50 * len(w))


def test_rules_base_against_brute_force(spark, make):
    rng = random.Random(7)
    rows = odd_rows() + [(100 + i, "".join(rng.choice(["a", "b ", "c ", "\n", "# ", "d\t", "é "]) for _ in range(300)), "en", "s") for i in range(40)]
    got = quality_rules(make(rows)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, *tuple(r)[1:7])
    want = sorted((r[0] is None, r[0] or 0, *rules_brute(r[1])) for r in rows)
    assert sorted(map(key, got)) == want
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules(make([])).count() == 0


def test_rules_divergence(spark, make):
    rng = random.Random(8)
    def text(i):
        return " ".join(rng.choice(["the", "of", "and", *(f"long{rng.randrange(9999)}word" for _ in range(7))]) for _ in range(150))
    rows = [(i, text(i), "en", "s") for i in range(40)]
    rows += [(100, " ".join(f"A{i}B%%%" for i in range(150)), "en", "s"), (101, " ".join(f"longer{i}words" for i in range(200)), "en", "s")]
    got = {r.doc_id: r for r in quality_rules(make(rows)).collect()}
    assert all(got[i].kept for i in range(40))
    assert not got[100].kept and got[100].class_distance > 0.25
    assert got[101].common_distance > max(got[i].common_distance for i in range(40))


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    d = [int(x) for x in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def base_brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def divergence(words, classes, docs):
    """Distances of a document by plain counting: of common words and of character classes."""
    def js(p, q):
        both = set(p) | set(q)
        part = lambda a, b: sum(a.get(k, 0) * math.log2(a.get(k, 0) / ((a.get(k, 0) + b.get(k, 0)) / 2)) for k in both if a.get(k, 0) > 0)
        return math.sqrt(max(0.0, min(1.0, (part(p, q) + part(q, p)) / 2)))

    total = Counter(w for d in docs for w in d)
    n = sum(total.values())
    common = {w: c / n for w, c in total.items() if c >= n / 400}
    own = Counter(words)
    p = {w: own[w] / len(words) for w in common if own[w]}
    return js({**p, None: 1 - sum(p.values())}, {**common, None: 1 - sum(common.values())})


def test_rules_distances_of_many_languages_and_long_words(make):
    """300 languages, some of long words only: each has its own reference, and distances are those of plain counting."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        own = [f"{'langeswort' if k % 3 else 'w'}{k}x{j}" for j in range(12)]
        for i in range(3):
            rows.append((k * 10 + i, " ".join(rng.choice(own) for _ in range(130)), f"l{k}", "s"))
    rows.append((9999, " ".join(f"fremd{rng.randrange(60)}" for _ in range(140)), "l1", "s"))
    got = {r.doc_id: r for r in quality_rules(make(rows)).collect()}
    by = {}
    for i, text, lang, _ in rows:
        by.setdefault(lang, []).append(text.split())
    for i, text, lang, _ in rows:
        assert got[i].common_distance == pytest.approx(divergence(text.split(), None, by[lang]), abs=1e-9)
    assert not got[9999].kept and sum(r.kept for r in got.values()) >= 890


def test_many_languages_are_told_apart(make):
    """More than 128 learned languages keep their labels."""
    rng = random.Random(4)
    alphabet = [chr(0x4E00 + i) for i in range(200)] + [chr(0x3400 + i) for i in range(100)]
    rows = [(k * 4 + i, " ".join(alphabet[k] * rng.randrange(1, 5) for _ in range(30)), f"l{k:03}", "s") for k in range(300) for i in range(2)]
    docs = make(rows)
    got = {r.doc_id: r.lang_pred for r in identify(docs, learn(docs)).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) >= 0.98 * len(rows)


def test_personal_data_base_against_brute_force(spark, make):
    rng = random.Random(9)
    parts = ["a@b.co", "x.y+z@mail.example.com", "_q@r.s", "@", ".", "1.2.3.4", "256.1.1.1", "001.002.003.004", "4532015112830366", "4532 0151-1283 0366",
             "+1 (415) 555-0100", "+49 30 123", "é", "\U0001f600", " ", " ", "\n", "12345678901234567890", "-", "9", "tel ", "key=abc123def456"]
    rows = odd_rows() + [(100 + i, "".join(rng.choice(parts) for _ in range(60)), "en", "s") for i in range(150)]
    rows += [(500, "1 " * 20_000, "en", "s"), (501, "a." * 20_000 + "@x" + ".y" * 20_000, "en", "s"), (502, "7" * 60_000, "en", "s"),
             (503, "a@b.c " * 3000, "en", "s"), (504, "1.2.3.4 " * 2000, "en", "s")]
    got = personal_data(make(rows)).collect()
    key = lambda i, b: (i is None, i or 0, b)
    assert sorted(key(r.doc_id, r.base) for r in got) == sorted(key(r[0], base_brute(r[1])) for r in rows)
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
        assert {k for k, _, _ in spans} <= {*KINDS, *GENERATORS}
    assert personal_data(make([])).count() == 0


def test_personal_data_learns_secrets(spark, make):
    rng = random.Random(10)
    rows = []
    for i in range(200):
        words = [f"word{rng.randrange(999)}"[:rng.randrange(4, 8)] for _ in range(40)]
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        extra = [f'token = "{hexes}"', "4532015112830366", f"{rng.randrange(10**14, 10**15)}", f"{rng.randrange(1, 9)}.{rng.randrange(9)}", "a.b@mail.com"][i % 5]
        words.insert(20, extra)
        rows.append((i, " ".join(words), "en", "s"))
    got = {r.doc_id: r for r in personal_data(make(rows)).collect()}
    assert all("secret:" in got[i].spans for i in range(0, 200, 5))
    assert all(got[i].spans == "" for i in range(3, 200, 5))  # version numbers


def test_redact(spark, make):
    docs = make([(1, "mail a.b@mail.com now \U0001f600 4532015112830366!", "en", "s"), (2, None, "en", "s"), (3, "none here", None, None),
                 (1, "mail a.b@mail.com now \U0001f600 4532015112830366!", "en", "s")]).withColumn("n_chars", F.lit(1).cast("long"))
    out = redact(docs)
    assert out.columns == docs.columns
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in out.filter("text is not null").collect())
    text = "mail <email> now \U0001f600 <card>!"
    assert rows == [(1, text, len(text)), (1, text, len(text)), (3, "none here", 9)]
    assert out.filter("text is null").count() == 1


def test_personal_data_neighbouring_numbers_and_long_keys(spark, make):
    """Numbers that follow each other or a date are judged one by one; keys go to their end."""
    rng = random.Random(13)
    tel = lambda: f"{rng.randrange(212, 990)}-555-{rng.randrange(1000, 9999)}"
    rows = [(i, f"call {tel()} or write version {rng.randrange(9)}.{rng.randrange(9)} on 20{rng.randrange(10, 24)}-01-05 in time", "en", "s") for i in range(150)]
    rows += [(200, "call 212-555-0199 646-555-0123 today", "en", "s"), (201, "call 212-555-0199 2024-01-05 today", "en", "s"),
             (202, "ssn 078-05-1120 212-555-0199. Thanks", "en", "s")]
    rows += [(300 + i, "token = " + "".join(rng.choice("abcdef0123456789") for _ in range(400)) + " end", "en", "s") for i in range(20)]
    got = {r.doc_id: r.spans for r in personal_data(make(rows)).collect()}
    assert got[200] == "number:5:17,number:18:30" and got[201] == "number:5:17" and got[202] == "number:4:15,number:16:28"
    assert all(re.search(r":408(,|$)", got[300 + i]) for i in range(20))


def test_personal_data_threshold_uses_all_held_out_candidates(spark, monkeypatch):
    from tessera.llm import pii
    monkeypatch.setattr(pii, "MAX_TRAINING", 100)
    known, fitted = pii.training(spark.range(3000).selectExpr("concat('m', id) AS m", "cast(id % 2 AS double) AS label"), 5)
    assert known.count() == 3000 and 900 < known.filter("held").count() < 1100
    assert 50 < fitted.count() < 150 and fitted.filter("held").count() == 0
