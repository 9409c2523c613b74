"""Text quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled

DIMS = 2048
_CLASSES = [(re.compile(r"[^\W\d_]+"), lambda m: ("A" if m[0].isupper() and len(m[0]) > 1 else "a") * (1 + (len(m[0]) > 5) + (len(m[0]) > 12))), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]
_SHAPES: dict[str, int] = {}


def shape(word: str) -> str:
    """A word's outline: letters by case and length, digits, and its own signs."""
    for pattern, to in _CLASSES:
        word = pattern.sub(to, word)
    return word[:12]


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) % DIMS


def _slot_of_word(word: str) -> int:
    found = _SHAPES.get(word)
    if found is None:
        found = _slot(shape(word))
        if len(_SHAPES) < 300_000:
            _SHAPES[word] = found
    return found


def term_counts(text: str) -> dict[int, float]:
    """Counts of word outlines, of equal neighbours and of repeated words, by hashed slot."""
    words = text.split()
    if not words:
        return {}
    counts = Counter(map(_slot_of_word, words))
    counts[_slot("=next")] += 4 * sum(map(operator.eq, words, words[1:]))
    if len(words) >= 20:
        counts[_slot("=again")] += max(0, len(words) - 2 * len(set(words)))
    return {k: v for k, v in counts.items() if v}


def vector(text: str) -> np.ndarray:
    """Log counts, scaled to shares of the text, as one dense row."""
    row = np.zeros(DIMS, np.float32)
    counts = term_counts(text)
    if counts:
        row[list(counts)] = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)) * (1000 / (1 + len(text.split()))))
    return row


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each slot occurs (DIMS numbers and the count of documents)."""

    def run(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                if counts := term_counts(text.as_py() or ""):
                    seen[list(counts)] += 1
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(seen[slots], n))], names=["slot", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "slot long, n long")
    found = {r["slot"]: r["n"] for r in parts.groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator()}
    out = np.zeros(DIMS)
    for slot, n in found.items():
        if slot >= 0:
            out[slot] = n
    return out, found.get(-1, 0)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, rank: int = 24, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> dict:
    """The latent space and the labelled vectors in it.

    At most ``max_labelled`` labelled ids are taken, those of least hash,
    which bounds what is broadcast; document frequencies cover all of
    ``docs``. Rows with a null id or label teach nothing.
    """

    def run(batches):
        for batch in batches:
            rows = [vector(t.as_py() or "").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["row", "y"])

    sample = labelled(docs, labels, max_labelled, id_col, text_col, label_col, "double").select("text", "y").mapInArrow(run, "row binary, y double").collect()
    seen, total = document_frequencies(docs, text_col)
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + 0.1
    x = np.array([np.frombuffer(r["row"], np.float32) for r in sample], np.float32).reshape(-1, DIMS) * idf
    y = np.array([r["y"] for r in sample], np.float32)
    # the right singular vectors, by way of the smaller Gram matrix of the columns in use
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    used = np.flatnonzero(x.any(axis=0))
    values, vectors = np.linalg.eigh(x[:, used].T @ x[:, used]) if len(used) else (np.zeros(0), np.zeros((0, 0)))
    basis = np.zeros((DIMS, min(rank, len(used))), np.float32)
    basis[used] = vectors[:, ::-1][:, : basis.shape[1]]
    latent = x @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return {"idf": idf, "basis": basis, "latent": latent, "y": y, "prior": float(y.mean()) if len(y) else 0.5}


def vote(rows: np.ndarray, model: dict, k: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest labelled vectors; those that tie at the last places share these."""
    x = (rows * model["idf"]) @ model["basis"]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    score = np.full(len(x), model["prior"])
    k = min(k, len(model["y"]))
    ok = norm[:, 0] > 1e-9
    if k and ok.any():
        cosine = (x[ok] / norm[ok]) @ model["latent"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(cosine, near, axis=1)
        last = close.min(axis=1, keepdims=True)
        weight = np.maximum(close, 0).astype(np.float64) ** 8 + 1e-9
        tied = cosine == last
        share = tied @ model["y"] / tied.sum(axis=1)
        label = np.where(close > last, model["y"][near], share[:, None])
        score[ok] = (weight * label).sum(axis=1) / weight.sum(axis=1)
    return np.clip(score, 0, 1)


def score(docs: DataFrame, model: dict, *, k: int = 15, threshold: float = 0.7, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    The model is broadcast; its size is bounded by ``max_labelled`` and
    ``rank``. Cosine products are exact and computed in blocks of ``block``
    rows. Texts that are null, empty or only white space have no direction and
    get the labelled rows' mean. Labelled vectors that tie for the last of the
    ``k`` places share these by the mean of their labels, so their order is of
    no matter. Repeated rows and null ids are scored like any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                s = vote(np.array([vector(t.as_py() or "") for t in part.column(1)]), shared.value, k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
