"""Exact top-k inner products by a vector-approximation file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def integer_vectors(vectors: DataFrame, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: each component as floor(scale * x), x as double.

    Rows whose id or vector is null, and vectors that are empty or hold null,
    NaN or infinite components, take no part.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ok = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    return ok.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def approximate(vectors: DataFrame, shift: int) -> DataFrame:
    """The approximation file: ``vec_id, cells``, a cell number of 2^shift units for each component.

    The numbers are as narrow as the largest component allows, a byte each
    where it is below 2^(shift + 7).
    """
    most = vectors.agg(F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -c - 1))))).first()[0] or 0
    kind = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if most >> shift < 1 << bits)
    return vectors.select("vec_id", F.transform("v", lambda c: F.shiftright(c, shift).cast(kind)).alias("cells"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: by way of doubles where all are below 2^53 and so exact, else as integers."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    return q.astype(np.int64) @ c.T.astype(np.int64)


def scan(cells: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, shift: int) -> DataFrame:
    """``query_id, vec_id, low, high``: score bounds of all that may be among a query's k best.

    A component c * 2^shift + r with 0 <= r < 2^shift bounds the inner
    product from the cells alone. A vector stays if its upper bound reaches
    the kth largest lower bound that its task has seen by then; later steps
    compare over all tasks. The queries of one block are broadcast.
    """
    shared = cells.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches):
        q, own = shared.value
        rest = (1 << shift) - 1
        low_part, high_part = np.minimum(q, 0).sum(axis=1) * rest, np.maximum(q, 0).sum(axis=1) * rest
        width = q.shape[1]
        best = np.full((len(q), k), np.iinfo(np.int64).min)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            fits = np.flatnonzero(sizes == width)
            if not len(fits):
                continue
            c = lists.flatten().to_numpy(zero_copy_only=False)
            c = c.reshape(-1, width) if len(fits) == len(sizes) else np.array([lists[int(i)].as_py() for i in fits])
            vec = batch.column(0).to_numpy()[fits]
            for at in range(0, len(q), 256):
                base = _products(q[at : at + 256], c) << shift
                low, high = base + low_part[at : at + 256, None], base + high_part[at : at + 256, None]
                itself = own[at : at + 256, None] == vec[None, :]
                low[itself] = np.iinfo(np.int64).min
                top = np.partition(low, len(vec) - k, axis=1)[:, -k:] if len(vec) > k else low
                both = np.concatenate([best[at : at + 256], top], axis=1)
                best[at : at + 256] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                rows, cols = np.nonzero((high >= best[at : at + 256].min(axis=1)[:, None]) & ~itself)
                yield pa.RecordBatch.from_arrays([pa.array(own[at + rows]), pa.array(vec[cols]), pa.array(low[rows, cols]), pa.array(high[rows, cols])], names=["query_id", "vec_id", "low", "high"])

    return cells.mapInArrow(run, "query_id long, vec_id long, low long, high long")


def _exact(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Read the exact vectors of candidates, and score them."""
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return candidates.join(vectors, "vec_id").join(queries, "query_id").select("query_id", "vec_id", product.alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, shift: int = 3, block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products, itself apart.

    ``vectors`` are those of ``integer_vectors``; ``queries`` holds a subset of their ids as
    ``query_id``. Queries go in blocks of about ``block`` (by a hash of the id), each one pass
    over the approximation file, so that what is broadcast stays bounded however many there
    are. Exact vectors are then read in order of the bounds: first those with the k best upper
    bounds of a query, which give a kth score that is certain to be reached; then those whose
    upper bound reaches it. Ties go to the smaller id, so that of equal vectors no more than
    k + 1 are searched. Fewer than k others: all of them. Repeated
    rows of one id count once (the smallest vector); vectors of another length than the query's
    have no score with it; no rows, no result.
    """
    spark = vectors.sparkSession
    vectors = stash(vectors.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    # of equal vectors only the k + 1 smallest ids can be among a query's k best
    among = Window.partitionBy("v").orderBy("vec_id")
    apart = vectors.withColumn("at", F.row_number().over(among)).where(F.col("at") <= k + 1).drop("at")
    cells = stash(approximate(apart, shift), "cells")
    asked = vectors.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").withColumn("width", F.size("v"))
    groups = asked.groupBy("width").count().collect()  # as many as there are vector lengths
    sizes = {r["width"]: -(-r["count"] // block) for r in groups}
    blocks = []
    if sizes:
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("width"))
        asked = stash(asked.withColumn("part", F.concat_ws("-", "width", F.pmod(F.xxhash64("vec_id"), parts))), "asked", by="part")
    for width, n in sorted(sizes.items()):
        for part in range(n):
            rows = asked.where(F.col("part") == f"{width}-{part}").select("vec_id", "v").toArrow()
            if not rows.num_rows:
                continue
            q = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
            blocks += stash(scan(cells, q, rows.column("vec_id").to_numpy(), k, shift), "near").inputFiles()
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, low long, high long").parquet(*blocks)
    best = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    reach = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).groupBy("query_id").agg(F.min("low").alias("least"))
    found = stash(found.join(reach, "query_id").where(F.col("high") >= F.col("least")).select("query_id", "vec_id", "high"), "candidates")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    ranked = found.withColumn("at", F.row_number().over(order))
    first = stash(_exact(ranked.where(F.col("at") <= k), vectors), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"))
    more = ranked.where(F.col("at") > k).join(kth, "query_id").where(F.col("high") >= F.col("kth"))
    scores = first.unionByName(_exact(more, vectors))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
