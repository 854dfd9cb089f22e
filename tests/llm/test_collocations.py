"""Collocations against listing all n-grams, and the index against the text it was made of."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessera.llm import collocations as C

from .conftest import odd_rows

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest, top):
    count = defaultdict(Counter)
    n = Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    count[lang or "und"][tuple(w[i:i + m])] += 1
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        rows_ = []
        for p, a in cand.items():
            if any(len(o) > len(p) and b >= a and any(o[i:i + len(p)] == p for i in range(len(o) - len(p) + 1)) for o, b in cand.items()):
                continue
            score, _, x, y = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), x, y))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(rows_[:top], 1)]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ünder", "A", "a", "中文", "x|y", "\x0bq"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".\n", "! ", "\r"]
    return [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 120))), rng.choice(["en", "en", "en", "de", None]), "s") for i in range(n)]


def check(make, rows, **limits):
    got = C.collocations(make(rows), **limits)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute([(r[2] if len(r) > 2 else None, r[1]) for r in rows], **limits)


def test_equals_brute_force_over_many_shards(make, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 700)
    monkeypatch.setattr(C, "CHUNK", 50)
    monkeypatch.setattr(C, "PART", 100)
    rows = corpus(250, 1)
    check(make, rows, least=8, longest=5, top=60)
    check(make, rows, least=3, longest=3, top=2000)


def test_triples_become_rows_only_where_their_cell_is_frequent(make, monkeypatch):
    rng = random.Random(9)
    rare = "; ".join(" ".join(rng.choices([f"w{i}" for i in range(30)], k=8)) for _ in range(800))
    rows = [(i, text, "en", "s") for i, text in enumerate([*rare.split("; "), *["a passage of six words here"] * 40])]
    rng.shuffle(rows)
    made, every = (make([]).sparkSession.sparkContext.accumulator(0) for _ in range(2))
    real = C._longer

    def counted(shared, least, longest):
        run, plain = real(shared, least, longest), real(shared[:1], least, longest)

        def counting(left, right):
            out = run(left, right)
            if least == 3:
                made.add(out.num_rows)
                every.add(plain(left, right).num_rows)
            return out

        return counting

    monkeypatch.setattr(C, "_longer", counted)
    monkeypatch.setattr(C, "SHARD", 1000)
    check(make, rows, least=6, longest=5, top=2000)
    assert 0 < made.value < every.value / 5
    monkeypatch.setattr(C, "BITS", 512)  # many triples in a cell: more rows, the same result
    monkeypatch.setattr(C, "CELLS", 128)
    check(make, rows, least=6, longest=5, top=2000)


def test_copies_and_overlaps(make):
    rows = [(i, "the very same passage in all of them, as it is", "en", "a") for i in range(30)] + [(99, "go go go go go go go", "en", "a")] * 3
    check(make, rows, least=10, longest=5, top=2000)


def test_odd_rows(make):
    check(make, odd_rows(), least=2, longest=5, top=2000)
    assert C.collocations(make([])).collect() == []
    assert C.collocations(make([(1, None, "en"), (2, " ., ", None)]), least=1).collect() == []


def test_order_is_that_of_the_first_symbols():
    rng = np.random.default_rng(0)
    for most in (3, 1 << 12, 1 << 20):
        codes = rng.integers(0, most, 500).astype(np.int32)
        padded = [*codes.tolist(), *[0] * 5]
        keys = [tuple(padded[i:i + 5]) for i in C._order(codes, 5)]
        assert keys == sorted(keys)


def one_shard(text, longest=5):
    """A shard of one text whose words are all frequent; they keep the ids of the shard as numbers."""
    batch = pa.record_batch({"lang": pa.array(["en"]), "text": pa.array([text.encode()])})
    run = C._index(longest)
    C.TaskContext, real = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)), C.TaskContext
    try:
        right = pa.Table.from_batches(run(iter([batch])))
    finally:
        C.TaskContext = real
    ids = np.arange(1, len(right["words"][0]) + 1)
    return C._Shard(pa.table({"id": ids, "gid": ids}), right), len(text.split())


def test_extensions_are_made_a_bounded_number_of_places_at_a_time(monkeypatch):
    rng = random.Random(5)
    shard, n = one_shard(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40_000)))
    every = (np.full(C.BITS // 32, 0xFFFFFFFF, np.uint32),) * 2

    def grown():
        got = shard.phrases()
        for size in range(2, 6):
            got = shard.extend(got, "forward" if size % 2 else "backward", every, 5 - size)
        return got

    grown()  # what a shard keeps is there from now on
    peaks, results = [], []
    for places in (1 << 30, 1 << 10):
        monkeypatch.setattr(C, "PLACES", places)
        pairs = shard.phrases()
        tracemalloc.start()
        pairs = shard.extend(pairs, "backward", every, 0)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        results.append((pairs, grown()))
    assert peaks[1] < peaks[0] / 3
    for a, b in zip(*results):
        assert a["n"].sum() > 0 and all((a[k] == b[k]).all() for k in ("words", "n"))
    assert results[0][0]["n"].sum() == n - 1 and results[0][1]["n"].sum() == n - 4
