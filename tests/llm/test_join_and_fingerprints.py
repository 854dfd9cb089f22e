"""N-gram Jaccard join and syncmer fingerprints against brute force."""

import hashlib
import random

from .conftest import odd_rows
from tessera.llm import ngram_join
from tessera.llm.ngram_join import bands, near_duplicates, one_per_class
from tessera.llm.syncmer import fingerprints


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def join_brute(rows, threshold=0.8):
    sets = [grams(r[1]) for r in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(i)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in members[find(i)] if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(members[find(i)]), links[i]))
    return sorted(out, key=repr)


def near_copies(seed, groups=12, copies=14):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en", "s"))
    return rows


def test_bands_reach_the_recall():
    for t, want in ((0.8, 0.9999), (0.7, 0.99), (0.9, 0.999)):
        b, r = bands(t, want)
        assert 1 - (1 - t ** r) ** b >= want and b * r <= 256


def test_join_against_brute_force(spark, make):
    rows = near_copies(1)
    got = [tuple(r)[:4] for r in near_duplicates(make(rows)).collect()]
    assert sorted(got, key=repr) == join_brute(rows)


def test_join_in_blocks(spark, make, monkeypatch):
    """Groups larger than a block meet block by block and lose no link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = near_copies(2, groups=4, copies=30)
    got = [tuple(r)[:4] for r in near_duplicates(make(rows)).collect()]
    assert sorted(got, key=repr) == join_brute(rows)


def test_join_odd_rows(spark, make):
    rows = odd_rows()
    got = [tuple(r)[:4] for r in near_duplicates(make(rows)).collect()]
    assert sorted(got, key=repr) == join_brute(rows)
    assert near_duplicates(make([])).count() == 0


def test_one_per_class(spark, make):
    rows = near_copies(3) + [(1000 + i, t, None, None) for i, t in enumerate([None, "", None])]
    docs = make(rows)
    kept = one_per_class(docs)
    assert kept.columns == docs.columns
    want = {r[1] for r in join_brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    odd = one_per_class(make(odd_rows())).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "")[:2] for r in odd) == sorted(
        [(False, i) for i in (1, 1, 2, 3, 4, 6, 7, 8, 10, 11)] + [(True, 0)])


def edited_brute(rows):
    """Rows of different ids only."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        out[r[0]] = (len(t), t[:len(t) - h] + nxt[:h])
    return out


def test_fingerprints_edit_and_likeness(spark, make):
    rows = [r for r in odd_rows() if r[0] != 1] + [(1, "a b c d e f g h", "en", "a")]
    rows = list({r[0]: r for r in rows}.values())
    got = fingerprints(make(rows)).collect()
    want = edited_brute(rows)
    assert len(got) == len(rows)
    by_text = {}
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert (r.n_chars, r.edited) == want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1


def test_fingerprints_over_many_ranges(spark, make):
    rng = random.Random(5)
    rows = [(i * 7 - 50, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))), "en", "s") for i in rng.sample(range(400), 300)]
    want = edited_brute(rows)
    for r in fingerprints(make(rows).repartition(7)).collect():
        assert (r.n_chars, r.edited) == want[r.doc_id]


def test_fingerprints_repeated_rows_and_small_tables(spark, make):
    rows = odd_rows()
    got = fingerprints(make(rows)).collect()
    assert len(got) == len(rows)
    assert {r.fingerprint for r in got if r.doc_id in (1, 9) and r.n_chars > 100} == {next(r.fingerprint for r in got if r.doc_id == 9)}
    (only,) = fingerprints(make([(4, "abcd", None, None)])).collect()
    assert only.edited == "abab" and only.near_next == 1.0
    assert fingerprints(make([])).count() == 0


def test_fingerprint_likeness_follows_jaccard(spark, make):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(2, " ".join(base), "en", "s"), (1, " ".join(base[:360] + [f"z{i}" for i in range(40)]), "en", "s")]
    got = {r.doc_id: r for r in fingerprints(make(rows)).collect()}
    a, b = grams(rows[0][1]), grams(rows[1][1])
    assert abs(got[2].near_next - len(a & b) / len(a | b)) < 0.2
    assert len(hashlib.sha256(got[2].edited.encode()).hexdigest()) == 64


def test_fingerprints_of_five_and_six_words(spark, make):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(5 + i % 2)), "en", "s") for i in range(60)] + [(60, " ", "en", "s")]
    got = {r.doc_id: r for r in fingerprints(make(rows)).collect()}
    assert all(got[i].fingerprint and got[i].near_next == 0 for i in range(60)) and got[60].fingerprint == ""
    assert len({r.fingerprint for r in got.values()}) == 61


def test_fingerprints_keep_all_anchors_in_place(spark, make):
    """A small passage at another place of long documents counts; the same words in other places don't."""
    rng = random.Random(12)
    long = lambda k: [f"{k}{rng.randrange(10**7)}" for _ in range(6000)]
    a, b, shared = long("a"), long("b"), [f"s{i}" for i in range(100)]
    rows = [(3, " ".join(a[:100] + shared + a[100:]), "en", "s"), (2, " ".join(b[:5000] + shared + b[5000:]), "en", "s")]
    got = {r.doc_id: r for r in fingerprints(make(rows)).collect()}
    jaccard = 96 / (2 * 6096 - 96)
    assert jaccard / 2 < got[3].near_next < jaccard * 2
    anchors = [got[3].fingerprint[i:i + 16] for i in range(0, len(got[3].fingerprint), 16)]
    places = [int(x[8:], 16) for x in anchors]
    assert len(places) > 2000 and places == sorted(set(places)) and places[-1] < 6100
    # 5-grams of one text, far apart and in reverse order in the other: anchors match, places don't
    parts = [" ".join(f"p{i}_{j}" for j in range(5)) for i in range(200)]
    rows = [(2, " ".join(parts), "en", "s"), (1, " ".join(f"{p} x{i} y{i}" for i, p in reversed(list(enumerate(parts)))), "en", "s")]
    got = {r.doc_id: r for r in fingerprints(make(rows)).collect()}
    assert {got[2].fingerprint[i:i + 8] for i in range(0, len(got[2].fingerprint), 16)} & {got[1].fingerprint[i:i + 8] for i in range(0, len(got[1].fingerprint), 16)}
    assert got[2].near_next == 0
