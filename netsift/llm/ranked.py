"""Ranked lexical search by the Best Position Algorithm over impact lists."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .words import word_blocks

_TALLY = "doc_id long, n long, terms array<int>, tfs array<int>"


def _tallies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: each document's number of terms, and how often it holds those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for body in batch.column(1):
                total, found = 0, Counter()
                for words in word_blocks(body.as_py()):
                    total += len(words)
                    found.update(words)
                    for word in found.keys() - known.keys():
                        del found[word]
                n.append(total)
                terms += [known[w] for w in found]
                tfs += found.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, _TALLY)


def _document_counts(tallies: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands; summed in the tasks first."""

    def run(batches):
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    found = tallies.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(width, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class ImpactLists:
    """The impact lists of a block of documents: for each term its documents, those of highest impact first.

    ``at[term, document]`` is a document's position in a term's list, -1
    where it is not in it: the way of random access.
    """

    def __init__(self, ids: np.ndarray, null: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        self.ids, self.null = ids, null
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc]))
        order = np.lexsort((doc, -impact, terms))
        self.docs, self.impact, terms = doc[order], impact[order], terms[order]
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.stops = np.append(self.starts[1:], len(terms))
        self.at = np.full((len(self.terms), len(ids)), -1, np.int32)
        row = np.repeat(np.arange(len(self.terms)), self.stops - self.starts)
        self.at[row, self.docs] = np.arange(len(terms)) - self.starts[row]


class Best:
    """The ``k`` best documents of one item so far: higher scores first, then null ids, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.null, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= max(self.bar(), 1)
        if keep.any():
            scores, null, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.null, null[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((ids, ~null, -scores))[: self.k]
            self.scores, self.null, self.ids = scores[order], null[order], ids[order]

    def bar(self) -> int:
        """The kth score; below 1 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


def search(lists: ImpactLists, terms: np.ndarray, times: np.ndarray, best: Best, step: int = 4) -> tuple[int, int]:
    """Show ``best`` the documents of a block by the Best Position Algorithm; documents scored, and positions up to the best ones.

    Every list keeps which of its positions have been seen, by its own reads
    or by random accesses, and its best position: the end of the run of seen
    positions from the top. A round reads each list on from there, directly
    at the next positions not seen yet, and scores each new document by
    random access to all lists. No document that was not seen can have more
    than the sum of the impacts at the best positions; the search stops once
    that is strictly below the kth score, as an equal score could still win
    by a smaller id.
    """
    place = np.searchsorted(lists.terms, terms)
    place = np.minimum(place, max(len(lists.terms) - 1, 0))
    here = lists.terms[place] == terms if len(lists.terms) else np.zeros(len(terms), bool)
    place, times = place[here], times[here]
    if not len(place):
        return 0, 0
    starts, sizes = lists.starts[place], lists.stops[place] - lists.starts[place]
    base = np.cumsum(sizes) - sizes
    seen = np.zeros(int(sizes.sum()) + 1, bool)  # one past the end, never seen
    scored = np.zeros(len(lists.ids), bool)
    position = np.zeros(len(place), np.int64)  # how many from the top are seen
    while True:
        open_ = np.flatnonzero(position < sizes)
        if not len(open_):
            break
        # the next positions not seen, of ``step`` from the best position on
        reach = position[open_, None] + np.arange(step)
        inside = reach < sizes[open_, None]
        reads = (base[open_, None] + reach)[inside]
        rows = (starts[open_, None] + reach)[inside]
        fresh = ~seen[reads]
        docs = np.unique(lists.docs[rows[fresh]])
        docs = docs[~scored[docs]]
        seen[reads] = True
        if len(docs):
            scored[docs] = True
            at = lists.at[place[:, None], docs]
            found = at >= 0
            seen[(base[:, None] + at)[found]] = True
            impact = np.where(found, lists.impact[np.where(found, starts[:, None] + at, 0)], 0)
            best.add(times @ impact, lists.null[docs], lists.ids[docs])
        # the best positions move on over all that is seen
        moving = open_
        while len(moving):
            ahead = position[moving, None] + np.arange(64)
            ok = (ahead < sizes[moving, None]) & seen[np.minimum(base[moving, None] + ahead, len(seen) - 1)]
            run = np.where(ok.all(axis=1), 64, ok.argmin(axis=1))
            position[moving] += run
            moving = moving[run == 64]
        last = np.minimum(position, sizes) - 1
        # a list that was seen to its end adds nothing to a document not seen
        left = np.where(position < sizes, times * lists.impact[starts + last], 0)
        if int(left.sum()) < max(best.bar(), 1):
            break
        step *= 2
    return int(scored.sum()), int(position.sum())


def _ranked(tallies: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, cells: int) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best documents of each task for each item.

    A task takes documents into impact lists until these would have
    ``cells`` places of random access; the kth scores go on from block to block.
    """
    shared = tallies.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        asked, w = shared.value
        best = [Best(k) for _ in asked]

        def take(parts):
            ids, null, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*parts))
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            lists = ImpactLists(ids, null, m, np.concatenate([[0], np.cumsum(sizes)]), terms, tfs, w)
            for (_, own, times), b in zip(asked, best):
                search(lists, own, times, b)

        held, docs, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = np.diff(part.column(2).offsets.to_numpy()).astype(np.int64)
                more = int(sizes.sum())
                if held and min(len(w), postings + more) * (docs + part.num_rows) > cells:
                    take(held)
                    held, docs, postings = [], 0, 0
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), sizes, part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64)))
                docs += part.num_rows
                postings += more
        if held:
            take(held)
        for (i, _, _), b in zip(asked, best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), i, np.int64)), pa.array(b.ids, mask=b.null), pa.array(b.scores)], names=["item", "doc_id", "score"])

    return tallies.mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 20, cells: int = 16_000_000, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, scores above 0.

    Terms are runs of ASCII letters and digits and of non-ASCII characters,
    A-Z lower-cased. A term's weight is floor(1000 ln((2N + 2) / (2df + 1)))
    for N documents with terms; a document of n terms, L / N on average, has
    m = 75 + (25 n N) div L, and a term that occurs tf times in it adds
    weight * ((10^9 tf) div (1000 tf + 12 m)) for each time it stands in the
    item. Equal scores go by smaller id.

    The index is dealt by documents: each task searches the impact lists of
    its own ones, so no list of a frequent word stands in one place, and
    nothing but each task's best is shuffled. Items go in blocks of about
    ``block_bytes`` (of text, and 256 for each item; by a hash of the row),
    whose terms are all that is broadcast; each block reads the documents once, for a table of their
    counts, and that table twice.

    Null and empty texts have no terms: such documents do not count, such
    items give no rows. Each repeated row is a document, or an item, of its own; null
    document ids come before others of their score; null item ids stay null.
    Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("body"))
    asked = asked.where(F.length("body") > 0)
    # an item weighs its text and what a task holds for it
    size = asked.agg(F.sum(F.length("body") + 256).alias("s")).first()["s"] or 0
    parts = -(-size // block_bytes)
    asked = stash(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "body"), F.lit(max(parts, 1)))), "items", by="part") if parts > 1 else asked.withColumn("part", F.lit(0))
    totals, out = None, None
    for part in range(parts):
        # as many rows as stand in a block of bounded text
        rows = asked.where(F.col("part") == part).select("item_id", "body").toArrow()
        counts = [Counter(w for words in word_blocks(b.as_py()) for w in words) for b in rows.column("body")]
        vocabulary: dict[bytes, int] = {}
        for found in counts:
            for word in found:
                vocabulary.setdefault(word, len(vocabulary))
        if not vocabulary:
            continue
        tallies = stash(_tallies(texts, vocabulary), "tallies")
        if totals is None:
            totals = tallies.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not totals["docs"]:
            break
        df = _document_counts(tallies, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        own = []
        for i, found in enumerate(counts):
            terms = np.array(sorted(vocabulary[w] for w in found), np.int64)
            by_term = {vocabulary[w]: n for w, n in found.items()}
            own.append((i, terms, np.array([by_term[t] for t in terms.tolist()], np.int64)))
        best = _ranked(tallies.where("n > 0"), own, weights, totals["docs"], totals["terms"], k, cells)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(counts)), pa.int64()), "item_id": rows.column("item_id")}))
        best = stash(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = best if out is None else out.unionByName(best)
    if out is None:
        kind = dict(asked.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
k AS (SELECT term, CAST(floor(1000 * ln((2 * t.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t WHERE term IN (SELECT term FROM q) GROUP BY term, t.n),
m AS (SELECT doc_id, 75 + (25 * len(w) * t.n) // t.l AS m FROM d, t WHERE len(w) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * k.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN k USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER r <= 20
"""
