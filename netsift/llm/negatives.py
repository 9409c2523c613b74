"""Hard negatives by Fagin's threshold algorithm over sorted lists of the dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def labelled_vectors(vectors: DataFrame, *, scale: int = 256, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, v``: each component as floor(scale * x), x as double; ``label`` is an expression in place of the column.

    Rows whose id, label or vector is null, and vectors that are empty or
    hold null, NaN or infinite components, take no part. Of repeated ids the
    row of least label and vector counts.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ok = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    kept = ok.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


class Lists:
    """A block of candidates, and for each dimension the list of them in rising order of its component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.order = np.argsort(v, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(v, self.order, 0)
        self.most = int(np.abs(v).max(initial=0))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products as whole numbers: by way of doubles where all are below 2^53 and so exact."""
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.v[rows].astype(float) @ anchor.astype(float)).astype(np.int64)
        return self.v[rows].astype(np.int64) @ anchor


class Windows:
    """The first ``k`` candidates of each score window ``low..high`` of one anchor, over all that it was shown."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Show some candidates; those that are not among a window's first k are let go."""
        near = (scores >= self.low.min()) & (scores <= self.high.max())
        scores, ids = np.concatenate([self.scores, scores[near]]), np.concatenate([self.ids, ids[near]])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        keep = np.zeros(len(scores), bool)
        for first, end in self._spans(scores):
            keep[first : min(end, first + self.k)] = True
        self.scores, self.ids = scores[keep], ids[keep]

    def _spans(self, scores: np.ndarray) -> list[tuple[int, int]]:
        return list(zip(np.searchsorted(-scores, -self.high, "left").tolist(), np.searchsorted(-scores, -self.low, "right").tolist()))

    def bar(self) -> int:
        """A score strictly below which no candidate can matter to any window: the least of their kth scores or lower ends."""
        return min(int(self.scores[first + self.k - 1]) if end - first >= self.k else int(low) for (first, end), low in zip(self._spans(self.scores), self.low.tolist()))


def search(lists: Lists, anchor: np.ndarray, own: int, label: int, same: bool, windows: Windows, step: int = 8) -> int:
    """Show ``windows`` the candidates of a block by the threshold algorithm; the depth that was read.

    Sorted access goes down the list of every dimension at once, from its
    large end where the anchor's component is positive, from its small end
    where it is negative; dimensions where it is 0 add nothing. Every row met
    is scored by random access. The threshold is the score of a row that
    would have the last read component in every dimension: no row that was
    not met can have more. The search stops once the threshold is strictly
    below each window's kth score (or its lower end), as an equal score could
    still win by a smaller id.
    """
    n = len(lists.ids)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    fits = (lists.labels == label) == same
    fits &= lists.ids != own
    met = np.zeros(n, bool)
    depth = 0
    while depth < n:
        to = min(n, depth + step)
        rows = np.concatenate([lists.order[n - to : n - depth, up].ravel(), lists.order[depth:to, down].ravel()])
        if not len(rows):  # an anchor of zeros scores 0 with every row
            rows, to = np.arange(n), n
        new = np.unique(rows[~met[rows]])
        met[new] = True
        new = new[fits[new]]
        if len(new):
            windows.add(lists.scores(new, anchor), lists.ids[new])
        depth, step = to, step * 2
        threshold = int(anchor[up] @ lists.sorted[n - to, up].astype(np.int64)) + int(anchor[down] @ lists.sorted[to - 1, down].astype(np.int64))
        if threshold < windows.bar():
            break
    return depth


def _searched(vectors: DataFrame, anchors: list[tuple[int, int, np.ndarray, Windows]], same: bool, block: int) -> DataFrame:
    """``anchor_id, vec_id, score``: what each task found for each anchor of a block of anchors.

    A task takes ``block`` candidates at a time into sorted lists; the
    windows' kth scores go on from one block to the next, and a task gives no
    more rows for an anchor than its windows hold.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        own = [(i, label, a, Windows(w.low, w.high, w.k)) for i, label, a, w in shared.value]
        width = len(own[0][2])

        def take(held):
            lists = Lists(*(np.concatenate(x) for x in zip(*held)))
            for i, label, a, w in own:
                search(lists, a, i, label, same, w)

        held, size = [], 0
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            fits = np.flatnonzero(sizes == width)
            if not len(fits):
                continue
            if len(fits) < len(sizes):
                batch = batch.take(pa.array(fits))
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), v))
            size += len(v)
            if size >= block:
                take(held)
                held, size = [], 0
        if size:
            take(held)
        for i, _, _, w in own:
            if len(w.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w.ids), i)), pa.array(w.ids), pa.array(w.scores)], names=["anchor_id", "vec_id", "score"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "anchor_id long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 16_384, anchor_block: int = 2048) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` are those of ``labelled_vectors``; ``anchors`` holds some of
    their ids as ``anchor_id``. An anchor's positives are the ``positives``
    other rows of its label with the highest inner products; for each, the
    first ``negatives`` rows of other labels with ``low`` * positive score <=
    100 * score <= ``high`` * positive score. Higher scores come first, ties
    by smaller id; all where there are fewer. A positive below 0 has an empty
    window and gives no row.

    Anchors go in blocks of about ``anchor_block`` (by a hash of the id),
    which are all that is broadcast; each is two passes over the candidates,
    which stay where they are: one for the positives, one for the windows
    that these fix. Candidates of another length than the anchor's have no
    score with it. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    vectors = stash(vectors, "vectors")
    asked = vectors.join(anchors.select(F.col("anchor_id").alias("vec_id")).distinct(), "vec_id", "left_semi").withColumn("width", F.size("v"))
    groups = {r["width"]: -(-r["count"] // anchor_block) for r in asked.groupBy("width").count().collect()}  # as many as there are vector lengths
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not groups:
        return none
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]), F.col("width"))
    asked = stash(asked.withColumn("part", F.concat_ws("-", "width", F.pmod(F.xxhash64("vec_id"), parts))), "anchors", by="part")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best, near = [], []
    for part in (f"{width}-{k}" for width, n in sorted(groups.items()) for k in range(n)):
        mine = asked.where(F.col("part") == part).select("vec_id", "label", "v").toArrow().to_pylist()
        if not mine:
            continue
        whole = np.array([-np.iinfo(np.int64).max]), np.array([np.iinfo(np.int64).max])
        own = [(r["vec_id"], r["label"], np.array(r["v"], np.int64), Windows(*whole, positives)) for r in mine]
        found = _searched(vectors, own, True, block).withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives)
        found = stash(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        best += found.inputFiles()
        # the windows of a block's anchors: as many as it has positives
        scores: dict[int, list[int]] = {}
        for r in found.where("positive_score >= 0").select("anchor_id", "positive_score").toArrow().to_pylist():
            scores.setdefault(r["anchor_id"], []).append(r["positive_score"])
        with_windows = []
        for i, label, a, _ in own:
            s = np.array(sorted(set(scores.get(i, ()))), np.int64)
            if len(s):
                with_windows.append((i, label, a, Windows(-(-low * s // 100), high * s // 100, negatives)))
        if with_windows:
            near += stash(_searched(vectors, with_windows, False, block), "near").inputFiles()
    if not near:
        return none
    pairs = spark.read.schema("anchor_id long, positive_id long, positive_score long").parquet(*best)
    found = spark.read.schema("anchor_id long, vec_id long, score long").parquet(*near).select("anchor_id", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = found.join(pairs, "anchor_id").where((low * F.col("positive_score") <= 100 * F.col("negative_score")) & (100 * F.col("negative_score") <= high * F.col("positive_score")))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
