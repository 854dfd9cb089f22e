"""Substring and suffix-array deduplication against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .conftest import odd_rows
from tessera.llm import suffix
from tessera.llm.substring import repeated_words
from tessera.llm.suffix import later_bytes, suffix_array


def words_brute(rows, length):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, texts):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for j in range(i, i + length)}
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def bytes_brute(rows, length):
    """Rows that are equal, id included, are one document."""
    docs = {(r[0], r[1] or ""): None for r in rows}
    first = {}
    order = sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0))
    for k in order:
        b = k[1].encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], (k, i))
    res = {}
    for k in docs:
        b = k[1].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] != (k, i):
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        res[k] = (k[0], len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return sorted((res[r[0], r[1] or ""] for r in rows), key=repr)


def corpus(seed, vocabulary=40, n=60):
    """Texts over few words that share passages, with edits."""
    rng = random.Random(seed)
    bank = [" ".join(f"t{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(bank) if rng.random() < 0.6 else " ".join(f"u{i}_{j}" for j in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 5))]
        text = " ".join(parts)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        rows.append((i, text, "en", "s"))
    return rows


@pytest.mark.parametrize("length", [35, 8])
def test_words_against_brute_force(spark, make, length):
    rows = corpus(1)
    got = [tuple(r) for r in repeated_words(make(rows), length).collect()]
    assert sorted(got, key=repr) == words_brute(rows, length)


def test_words_odd_rows(spark, make):
    rows = odd_rows()
    got = [tuple(r) for r in repeated_words(make(rows), 35).collect()]
    assert sorted(got, key=repr) == words_brute(rows, 35)
    assert repeated_words(make([]), 35).count() == 0


@pytest.mark.parametrize("hot", [1000, 1])
def test_bytes_against_brute_force(spark, make, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = corpus(2, n=40)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in later_bytes(make(rows), 100).collect()]
    assert sorted(got, key=repr) == bytes_brute(rows, 100)


def test_bytes_odd_rows(spark, make):
    # rows of one id with different texts are ordered by a hash: leave the second one without a match
    rows = odd_rows()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in later_bytes(make(rows), 100).collect()]
    assert sorted(got, key=repr) == bytes_brute(rows, 100)
    assert later_bytes(make([]), 100).count() == 0


def test_suffix_array_is_sorted():
    import numpy as np
    rng = np.random.default_rng(3)
    for symbols in (2, 5, 255):
        t = np.append(rng.integers(1, symbols + 1, 3000).astype(np.uint8), 0).astype(np.uint8)
        t[500:900] = t[1500:1900]
        t[100:300] = 1  # a long run
        order = suffix_array(t, 104)
        assert sorted(order.tolist()) == list(range(len(t)))
        keys = [bytes(t[i:i + 104]) for i in order]
        assert keys == sorted(keys)


def test_digest_of_query(spark, make, monkeypatch):
    import hashlib
    from tessera.llm import queries
    rows = corpus(3, n=20)
    monkeypatch.setattr(queries, "documents", lambda s, d: make(rows))
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, "").collect()}
    for doc_id, n, removed, kept in words_brute(rows, 35):
        assert (got[doc_id].n_words, got[doc_id].n_removed) == (n, removed)
        assert got[doc_id].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
