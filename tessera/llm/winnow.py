"""Content-defined anchors over sequences of units (words or bytes), in numpy.

Every window of ``length`` units has one anchor: the k-gram inside it with the least hash (the
leftmost of equals). Equal windows have equal anchors at equal offsets, so windows need to be
compared only if their anchors are equal. Neighbouring windows mostly share their anchor; the
windows of one anchor occurrence are its *segment*: ``n`` consecutive starts from ``start``, which
cover n + length - 1 units. There is about one anchor for (length - k + 2) / 2 units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import per_worker

#: Units are hashed in batches of about this many bytes of text.
BATCH = 1 << 21
_B = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(21, (n - 1).bit_length())

    def make(base: int) -> np.ndarray:
        out = np.full(size + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return per_worker(f"powers {size}", lambda: (make(_B), make(pow(_B, -1, 1 << 64))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hashes:
    """Hashes of all runs of units by prefix sums: those of [a, b) cost one multiplication."""

    def __init__(self, units: np.ndarray):
        self.pw, self.inv = _powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.pw[:len(units)], dtype=np.uint64, out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a])


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers for the bytes of some texts, and where each text ends."""
    table = per_worker("bytes", lambda: mix(np.arange(1, 257, dtype=np.uint64)))
    return table[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([len(t) for t in texts])


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, and where each text ends in words."""
    words = [t.split() for t in texts]  # bytes split at exactly the ASCII white space
    ends = np.cumsum([len(w) for w in words])
    flat = [x for w in words for x in w]
    if not flat:
        return np.zeros(0, np.uint64), ends
    units, stops = byte_units(flat)
    h = Hashes(units)
    lengths = np.diff(stops, prepend=0)
    return mix(h.runs(stops - lengths, stops) + lengths.astype(np.uint64)), ends


UNITS = {"words": word_units, "bytes": byte_units}


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    m, have = key, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have:]) if have < w else m


def segments(units: np.ndarray, ends: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """The segments of some texts: text, anchor (hash), hash (of all its units and the anchor's
    place in them), start (in the text), n, off (from the start to the anchor)."""
    none = {c: np.zeros(0, np.int64) for c in ("text", "anchor", "hash", "start", "n", "off")}
    if len(units) < length:
        return none
    h = Hashes(units)
    grams = h.windows(k)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    key = (grams >> bits << bits) | place
    at = (_least(key, length - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # runs of starts with the same anchor; a text's last length - 1 places start no window
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes
    whole = sizes >= length
    edge = np.append(True, at[1:] != at[:-1])
    edge[begins[whole]] = True
    first = np.flatnonzero(edge)
    doc = np.searchsorted(ends, first, "right")
    n = np.minimum(np.append(first[1:], len(at)), ends[doc] - length + 1) - first
    first, doc, n = first[n > 0], doc[n > 0], n[n > 0]
    if not len(first):
        return none
    a, anchor = first, at[first]
    whole = h.runs(a, a + n + length - 1) + mix((anchor - a).astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64))
    return {"text": doc, "anchor": grams[anchor].view(np.int64), "hash": mix(whole).view(np.int64),
            "start": a - np.where(doc > 0, ends[doc - 1], 0), "n": n, "off": anchor - a}


def batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about ``BATCH`` bytes together, with the index of the first."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH:
            yield first, texts[first:i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
