"""Language identification of mixed-language text (dealt operator 8).

A word (a maximal run of letters) is scored for each learned language by the log probabilities of
its letter trigrams, boundaries included. The script of the word (fixed code point ranges) narrows
the candidates to languages that were seen with it. Viterbi over the words of a document, with a
penalty for each switch, labels spans; the language with the most letters is the prediction.

The trigram counts are gathered from all training rows by one aggregate. Trigrams are hashed to
``BUCKETS`` cells, so the model has BUCKETS x languages numbers whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_worker

BUCKETS = 1 << 14
#: Text is scored in pieces of this many characters, to bound a task's memory.
PIECE = 1 << 20
BATCH = 1 << 19
#: Rows are labelled in slices of about this many bytes of text; a longer text is a slice of its own.
SLICE = 1 << 21

# FIXED VALUES: first and last code points of scripts (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letter_table() -> np.ndarray:
    return per_worker("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def _script(points: np.ndarray) -> np.ndarray:
    firsts = np.array([a for _, a, _ in SCRIPTS], np.uint32)
    lasts = np.array([b for _, _, b in SCRIPTS], np.uint32)
    ids = np.array([SCRIPT_NAMES.index(n) for n, _, _ in SCRIPTS], np.int8)
    at = np.searchsorted(firsts, points, "right") - 1
    return np.where((at >= 0) & (points <= lasts[at]), ids[at], 0)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters of some texts: hashed trigrams, where words start, and of each word the index
    of its text and its script."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    gap = np.zeros(1, np.uint32)
    points = np.concatenate([gap, *[x for p in parts for x in (p, gap)]])
    letter = _letter_table()[np.minimum(points, 0x10FFFF)]
    at = np.flatnonzero(letter)
    c = np.where(letter, points, 0).astype(np.uint32)
    h = c[at - 1] * np.uint32(2654435761) ^ c[at] * np.uint32(2246822519) ^ np.append(c, gap)[at + 1] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    h >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    starts = np.flatnonzero(~letter[at - 1])
    where = at[starts]
    return h, starts, np.searchsorted(ends, where - 1, "right"), _script(points[where])


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in lower case, cut into pieces and batched; with the index of each piece's text."""
    at: list[int] = []
    batch: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for a in range(0, max(len(t), 1), PIECE):
            at.append(i)
            batch.append(t[a:a + PIECE])
            held += len(batch[-1])
            if held >= BATCH:
                yield at, batch
                at, batch, held = [], [], 0
    if batch:
        yield at, batch


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``SLICE`` bytes of text together."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    part = (np.cumsum(size) - size) // SLICE
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    for a, b in zip(edges, np.append(edges[1:], len(part))):
        yield batch.slice(int(a), int(b - a))


def learn(docs: DataFrame) -> dict | None:
    """Trigram model of ``docs`` (text, lang); rows with a NULL text or lang teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _slices(batch):
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    texts = [t.as_py() for t, x in zip(part.column(1), langs) if x == lang]
                    cells = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    for _, piece in _pieces(texts):
                        h, starts, _, script = _trigrams(piece)
                        cells[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                        cells[BUCKETS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for lang, cells in sums.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(cells[at])], ["lang", "cell", "n"])

    rows = (docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
            .mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    got = rows.toPandas()
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    cells = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    cells[got["lang"].map({x: i for i, x in enumerate(langs)}), got["cell"]] = got["n"]
    grams, script = cells[:, :BUCKETS], cells[:, BUCKETS:]
    logs = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
    seen = script >= 0.01 * script.sum(1, keepdims=True)
    seen[:, ~seen.any(0)] = True  # a script that no language was learned with narrows nothing
    return {"langs": langs, "logs": logs, "seen": seen.T}


def _viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best label of each word; all documents advance together, one word at a time."""
    counts = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    k = scores.shape[1]
    back = np.empty(scores.shape, np.int32)
    own = np.arange(k, dtype=np.int32)
    best = np.zeros((n_docs, k), np.float32)
    active = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), "right")
    for t, a in enumerate(active):
        w = first[:a] + t
        v = best[:a]
        top = v.argmax(1)
        high = v[np.arange(a), top] - np.float32(penalty)
        switch = v < high[:, None]
        back[w] = np.where(switch, top[:, None].astype(np.int32), own)
        best[:a] = np.maximum(v, high[:, None]) + scores[w]
    label = np.empty(len(doc), np.int32)
    now = best.argmax(1).astype(np.int32)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        w = first[:a] + t
        label[w] = now[:a]
        now[:a] = back[w, now[:a]]
    return label


def identify(docs: DataFrame, model: dict | None, penalty: float = 12.0) -> DataFrame:
    """Predict the language of each row of ``docs`` (doc_id, text), one row per row.

    Columns: doc_id, lang_pred (a learned language; ``und`` for a NULL text or one without
    letters, or if nothing was learned), score (share of the letters labelled so, 0 for ``und``),
    spans (language:first word:end, words being runs of letters). Ties go to the language that
    sorts first. Texts are cut every ``PIECE`` characters for scoring only; Viterbi runs over the
    whole document. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _slices(batch):
                yield _label(part, m, penalty)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, spans string")


def keep_identified(docs: DataFrame, model: dict | None, least: float = 0.5, penalty: float = 12.0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others), unchanged, whose language is identified with
    a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                got = _label(part.select(["doc_id", "text"]), shared.value, penalty)
                yield part.filter(pc.and_(pc.not_equal(got.column(1), "und"), pc.greater_equal(got.column(2), least)))

    return docs.mapInArrow(run, docs.schema)


def _label(batch: pa.RecordBatch, m: dict | None, penalty: float) -> pa.RecordBatch:
    n = batch.num_rows
    pred, score, spans = ["und"] * n, [0.0] * n, [""] * n
    if m:
        scores, docs, sizes = [], [], []
        for at, texts in _pieces([t.as_py() for t in batch.column(1)]):
            h, starts, text, script = _trigrams(texts)
            if len(starts):
                s = np.stack([np.add.reduceat(log[h], starts) for log in m["logs"]], 1)
                scores.append(np.where(m["seen"][script], s, np.float32(-1e4)))
                docs.append(np.array(at)[text])
                sizes.append(np.diff(np.append(starts, len(h))))
        if docs:
            doc, size = np.concatenate(docs), np.concatenate(sizes)
            label = _viterbi(np.concatenate(scores), doc, n, penalty)
            k = len(m["langs"])
            letters = np.bincount(doc * k + label, size, n * k).reshape(n, k)
            edge = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(label) != 0)))
            begin = np.searchsorted(doc, doc[edge], "left")
            ends = np.append(edge[1:], len(doc))
            runs: dict[int, list[str]] = {}
            for d, x, a, b in zip(doc[edge].tolist(), label[edge].tolist(), (edge - begin).tolist(), (ends - begin).tolist()):
                runs.setdefault(d, []).append(f"{m['langs'][x]}:{a}:{b}")
            for d, r in runs.items():
                top = int(letters[d].argmax())
                pred[d], score[d], spans[d] = m["langs"][top], float(letters[d, top] / letters[d].sum()), ",".join(r)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())],
                                      ["doc_id", "lang_pred", "score", "spans"])
