"""Toxicity severity by cumulative-link ordinal regression."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> set[str]:
    """A word's features: itself and its first four, five and six letters."""
    return {word, f"{word[:4]}*", f"{word[:5]}*", f"{word[:6]}*"}


def counts(text: str, vocabulary: dict[str, int], cache: dict[str, tuple[int, ...]]) -> dict[int, int]:
    """How often each term of the vocabulary occurs in the text; cache: terms by word, bounded."""
    out: dict[int, int] = {}
    for word, n in Counter(_WORD.findall(text.lower())).items():
        ids = cache.get(word)
        if ids is None:
            ids = tuple(vocabulary[t] for t in terms(word) if t in vocabulary)
            if len(cache) < 300_000:
                cache[word] = ids
        for i in ids:
            out[i] = out.get(i, 0) + n
    return out


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str, label_col: str, kind: str = "int") -> DataFrame:
    """``id, y, text`` of at most ``max_labelled`` labelled ids, those of least hash; of several texts under one id the first in order."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast(kind).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    n = labels.count()
    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    keep = labels.where(h < int((1 << 30) * min(1.0, 1.2 * max_labelled / max(n, 1))) + 1).orderBy(h, "id").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(keep), "id")
    return stash(sample.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")


def select_vocabulary(sample: DataFrame, max_terms: int, min_docs: int) -> list[tuple[str, float]]:
    """The terms that speak most for a grade above 0, with their log odds.

    Terms are counted by document and grade in one aggregation over the
    sample; only the ``max_terms`` best come to the driver.
    """

    def run(batches):
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                found = list(set().union(*map(terms, words))) if words else []
                bad = int(y.as_py() > 0)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([bad] * len(found), pa.int32())], names=["term", "bad"])

    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("bad")).first()
    bad, good = sizes["bad"], sizes["n"] - sizes["bad"]
    by_term = sample.select("text", "y").mapInArrow(run, "term string, bad int").groupBy("term").agg(F.sum("bad").alias("b"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("b") + 0.5) / (good + 1))
    # evidence: the log odds times the root of the counts behind them
    best = by_term.where(F.col("b") >= min_docs).withColumn("odds", odds).where("odds > 1").orderBy((F.col("odds") * F.sqrt("b")).desc(), "term").limit(max_terms)
    return [(r["term"], r["odds"]) for r in best.collect()]


def design(sample: list[dict[int, int]], width: int) -> np.ndarray:
    x = np.zeros((len(sample), width), np.float32)
    for row, found in zip(x, sample):
        if found:
            row[list(found)] = np.log1p(np.fromiter(found.values(), np.float64, len(found)))
    return x


def fit_cumulative_link(x: np.ndarray, y: np.ndarray, grades: int, *, l2: float = 1e-4, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and the ordered thresholds.

    P(grade > k) = sigmoid(x.w - theta_k); thresholds stay ordered as a first
    one and positive steps. Adam on the mean log likelihood.
    """
    n, d = x.shape
    w, free = np.zeros(d), np.zeros(grades - 1)
    state = [np.zeros(d + grades - 1), np.zeros(d + grades - 1)]
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        above = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - theta, -30, 30)))  # P(grade > k)
        edge = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        p = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-9)
        slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
        # d log p / d(x.w - theta_k)
        at = np.zeros((n, grades + 1))
        at[np.arange(n), y] += slope[np.arange(n), y] / p
        at[np.arange(n), y + 1] -= slope[np.arange(n), y + 1] / p
        g_theta = at[:, 1:grades].mean(axis=0)  # of -log p by theta
        g_free = np.cumsum(g_theta[::-1])[::-1].copy()
        g_free[1:] *= np.exp(free[1:])
        grad = np.concatenate([-(x.T @ at.sum(axis=1)) / n + l2 * w, g_free])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, free = w - move[:d], free - move[d:]
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(docs: DataFrame, labels: DataFrame, *, grades: int = 3, max_labelled: int = 12_000, max_terms: int = 1000, min_docs: int = 3, severe: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> dict:
    """Fit on at most ``max_labelled`` labelled rows.

    ``label_col`` holds grades 0..grades-1. Where it is only 0 or 1 and
    ``grades`` is 3, grade 2 is given to those labelled 1 that hold ``severe``
    or more words with terms of the toxic side. Rows with null ids or labels
    teach nothing; without any toxic row every severity is 0.
    """
    sample = labelled(docs, labels, max_labelled, id_col, text_col, label_col)
    chosen = select_vocabulary(sample, max_terms, min_docs)
    vocabulary = {t: i for i, (t, _) in enumerate(chosen)}
    toxic_side = {i for i, (_, odds) in enumerate(chosen) if odds > 3}

    def run(batches):
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [counts(t.as_py() or "", vocabulary, cache) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), batch.column(1)], names=["i", "n", "y"])

    rows = sample.select("text", "y").mapInArrow(run, "i array<int>, n array<int>, y int").collect()
    found = [dict(zip(r["i"], r["n"])) for r in rows]
    y = np.array([r["y"] for r in rows], np.int64)
    if len(y) and y.max() == 1 and grades == 3:
        y = y + np.array([bool(g) and sum(n for i, n in c.items() if i in toxic_side) >= severe for g, c in zip(y, found)])
    if not len(y) or not y.max() or not vocabulary:
        return {"vocabulary": {}, "w": np.zeros(0), "theta": np.full(grades - 1, 30.0)}
    w, theta = fit_cumulative_link(design(found, len(vocabulary)), np.clip(y, 0, grades - 1), grades)
    return {"vocabulary": vocabulary, "w": w, "theta": theta}


def score(docs: DataFrame, model: dict, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` for every row: the expected grade and P(grade > 0).

    With ``keep`` the rows below ``threshold`` come back as they were, all
    columns unchanged, and nothing else. Null and empty texts have no terms
    and score like a text without any; repeated rows and null ids are scored
    like any. The broadcast model is bounded by ``max_terms``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def severity(column) -> np.ndarray:
        m = shared.value
        cache = m.setdefault("cache", {})
        logit = np.array([sum(m["w"][i] * np.log1p(n) for i, n in counts(t.as_py() or "", m["vocabulary"], cache).items()) for t in column], float)
        return 1 / (1 + np.exp(-np.clip(logit[:, None] - m["theta"], -30, 30)))

    if keep:
        at = docs.columns.index(text_col)

        def kept(batches):
            for batch in batches:
                yield batch.filter(pa.array(severity(batch.column(at)).sum(axis=1) < threshold))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches):
        for batch in batches:
            above = severity(batch.column(1))
            s = above.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(above[:, 0]), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic int")
