"""Packing and mixing: exact round trips, bounds and targets."""

import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from .conftest import odd_rows
from tessera.llm.mixing import mix, mixed
from tessera.llm.packing import best_plan, encoder, pack


def pieces_brute(rows, max_len):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % max_len + 1, len(ids) + 1, max_len)]
        out += [(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=repr)


def check_places(got, max_len):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by)


def test_pack_odd_rows(spark, make):
    rows = odd_rows() + [(20, "a <|endoftext|> b", "en", "a"), (21, "z" * 3000 + " " * 2500, "en", "a")]
    got = pack(make(rows), max_len=64).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == pieces_brute(rows, 64)
    check_places(got, 64)
    assert pack(make([])).count() == 0


def test_pack_many(spark, make):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(0, 3000), "en", "a") for i in range(300)]
    got = pack(make(rows)).collect()
    n = check_places(got, 1024)
    least = -(-sum(r.length for r in got) // 1024)
    assert least <= n <= least * 1.03 + 1


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), encoder(path)
    rng = random.Random(8)
    alphabet = "ab cdE é中\U0001f600\n\t'  .,1290#  "
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    for _ in range(30):
        counts = {rng.randrange(1, 257): rng.randrange(1, 40) for _ in range(rng.randrange(1, 90))}
        rows = best_plan(dict(counts), 256, 16)
        placed, room = {}, {}
        for n, rank, many, seq, offset in rows:
            for i in range(many):
                assert (n, rank + i) not in placed
                placed[n, rank + i] = seq + i
                room.setdefault(seq + i, []).append((offset, n))
        assert len(placed) == sum(counts.values())
        assert all(rank < counts[n] for n, rank in placed)
        for places in room.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 256
    assert best_plan({}) == []


def targets_brute(sizes):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        left = goal - sum(fixed.values())
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        above = [k for k in free if share[k] > 2 * sizes[k]]
        if not above:
            return fixed | share
        fixed |= {k: 2.0 * sizes[k] for k in above}


def mixture(seed=3, n=3000):
    rng = random.Random(seed)
    return [(i, "w " * rng.randrange(0, 200), "en", rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(n)]


def test_mix_meets_targets(spark, make):
    rows = mixture()
    got = mix(make(rows)).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + size[r[0]]
    want, taken = targets_brute(by), {}
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        # half of one of the shortest documents, or a hundredth
        assert abs(taken[s] - t) <= max(0.01 * t, 10)
    again = mix(make(rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_is_near_its_targets_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    by, sizes = {}, {}
    for r in mix(docs).collect():
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
        sizes.setdefault(r.source, []).append(r["size"])
    for source, (target, taken) in by.items():
        assert abs(taken - target) <= max(0.01 * target, np.median(sizes[source]) / 2), source


def test_mix_of_long_tailed_sources():
    """Log-normal sizes: what is long never stays fractional while shorter ones can make up for it."""
    from tessera.llm.mixing import _pivot
    rng = np.random.default_rng(0)
    for _ in range(300):
        size = sorted((1 + rng.lognormal(5, 1.5, 60)).astype(int).tolist(), reverse=True)
        share = float(rng.uniform(0.1, 0.9))
        out = _pivot(size, [share] * 60, rng.random)
        left = [i for i, x in enumerate(out) if 0 < x < 1]
        assert len(left) <= 1 and all(0 <= x <= 1 for x in out)
        assert abs(sum(s * x for s, x in zip(size, out)) - share * sum(size)) < 1e-6 * sum(size)
        assert not left or size[left[0]] <= 0.02 * sum(size)


def test_mix_of_many_equal_rows(make):
    """A third of all rows are one row: one entry, whose rows share the copies."""
    rows = mixture(5, 600) + [(7777, "w " * 90, "en", "a")] * 300 + [(None, "w " * 50, "en", "b")] * 100
    got = mix(make(rows)).collect()
    assert len(got) == len(rows)
    assert len({r.copies for r in got if r.doc_id == 7777}) <= 2
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(b - t) <= max(0.01 * t, 10) for t, b in by.values())


def test_mix_keeps_expectations(spark, make):
    """Over seeds, a document is taken target / source size times on average."""
    rows = [(i, "w " * (10 + i), "en", "a") for i in range(12)] + [(100, "w " * 400, "en", "b"), (101, "w " * 50, "en", "c")]
    docs, runs = make(rows).cache(), 12
    total, rate = {}, {}
    for seed in range(runs):
        for r in mix(docs, seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
            rate[r.source] = r.target / r.source_size
    mean = np.mean([total[i] / runs for i in range(12)])
    assert abs(mean - rate["a"]) < 0.15


def test_mix_odd_rows(spark, make):
    rows = odd_rows()
    docs = make(rows)
    got = mix(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted(
        (r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows if r[0] is not None)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert sum(1 for _ in out.collect()) == sum(r.copies for r in got)
    assert mix(make([])).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mix(make([(1, None, None, None), (2, "", "en", "a")])).collect())
