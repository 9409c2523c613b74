"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Token positions that count (1) and that any token may fill (0). In items of
#: 8 words or more, every way to change as many words as a share of 80 % of a
#: window allows (one of 8 or 9, two of 10 to 13) leaves a seed of one mask whole.
MASKS = ("11111", "111011", "11010011")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def _seed(array: str, at: str, mask: str) -> Column:
    picked = [F.expr(f"{array}[{at} + {k}]") for k, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(mask), *picked)


def _seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """A row for each position and mask that fits: ``at`` (from 0) and ``seed``; no seed where the mask ends beyond."""
    span = min(map(len, masks))
    # no filter on the size: Catalyst would cut the text into words twice
    starts = F.when(F.size("w") >= span, F.sequence(F.lit(0), F.size("w") - span)).otherwise(F.array().cast("array<int>"))
    placed = df.withColumn("at", F.explode(starts))
    own = [_seed("w", "at", m) if len(m) == span else F.when(F.col("at") + len(m) <= F.size("w"), _seed("w", "at", m)) for m in masks]
    return placed.withColumn("seed", F.explode(F.array(*own)))


def _possible(seeds: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows of ``seeds`` whose bit is set by a seed of ``wanted``: none of its own is lost.

    The bits are a table of at most 2^(bits - 6) rows of 64, whatever the size
    of ``wanted``, so it may be broadcast.
    """
    word, bit = F.shiftright("seed", 64 - bits + 6), F.shiftright("seed", 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    table = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("set"))
    marked = seeds.withColumns({"word": word, "bit": bit}).join(F.broadcast(table), "word")
    return marked.where(F.call_function("shiftright", F.col("set"), F.col("bit")).bitwiseAND(F.lit(1)) == 1).drop("word", "bit", "set")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, min_overlap: int = 13, min_share: float = 0.8, max_broadcast_seeds: int = 200_000, filter_bits: int = 24, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, doc_hash, item_id, at``: where a document overlaps a benchmark item.

    Both sides are cut into words; each mask hashes the words at its ones, at
    every position. Equal hashes put document and item in line; an overlap
    holds if, around the hit, some window of ``min_overlap`` words in line
    (the whole item, where shorter) has a share of ``min_share`` equal words.
    The item seeds are broadcast only where they are at most
    ``max_broadcast_seeds``. Else the documents' seeds are thinned by a bit
    table of fixed size (2^``filter_bits`` bits) and joined by shuffle without
    their text; the words are joined back to the hits.

    Null or empty texts, and texts of fewer words than the shortest mask,
    overlap nothing. Null ids are kept as null; ``doc_hash`` tells rows of one
    id apart, and repeated rows give equal results. Empty tables give no rows;
    other columns are not read.
    """
    span, reach = max(map(len, masks)), min_overlap - 1

    def around(at: str, prefix: str) -> list[Column]:
        """What lies around a seed: up to ``reach`` words on either side of the longest mask's reach."""
        before = F.least(F.col(at), F.lit(reach))
        return [before.alias(f"{prefix}_before"), F.slice("w", F.col(at) - before + 1, before + span + reach).alias(f"{prefix}_around")]

    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.xxhash64(F.col(item_id_col), F.col(item_text_col)).alias("item_key"), words(F.col(item_text_col)).alias("w"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("doc_hash"), words(F.col(text_col)).alias("w"))
    wanted = _seeds(items, masks).where("seed is not null")
    if wanted.limit(max_broadcast_seeds + 1).count() <= max_broadcast_seeds:
        mine = wanted.select("seed", "item_id", *around("at", "i"), F.size("w").alias("i_words"))
        hits = _seeds(texts, masks).join(F.broadcast(mine), "seed")
        # the array of one keeps what follows out of the join's condition, where each position would carry its whole text
        part = F.struct("at", *around("at", "d"), "i_before", "i_around", "i_words")
        hits = hits.select("doc_id", "doc_hash", "item_id", F.explode(F.array(part)).alias("x")).select("doc_id", "doc_hash", "item_id", "x.*")
    else:
        theirs = wanted.select("seed", "item_key", F.col("at").alias("i_at"))
        doc_key = F.xxhash64("doc_id", "doc_hash").alias("doc_key")
        mine = _possible(_seeds(texts, masks).select(doc_key, "at", "seed").where("seed is not null"), theirs, filter_bits)
        met = mine.join(theirs, "seed").select("doc_key", "at", "item_key", "i_at").distinct()
        met = met.join(texts.withColumn("doc_key", doc_key), "doc_key").select("doc_id", "doc_hash", "item_key", "i_at", "at", *around("at", "d"))
        hits = met.join(items, "item_key").select("doc_id", "doc_hash", "item_id", "at", "d_before", "d_around", *around("i_at", "i"), F.size("w").alias("i_words"))

    # put both in line: drop what only one of them has in front
    line = hits.select(
        "doc_id", "doc_hash", "item_id", "at", "i_words",
        F.expr("slice(d_around, d_before - least(d_before, i_before) + 1, size(d_around))").alias("d"),
        F.expr("slice(i_around, i_before - least(d_before, i_before) + 1, size(i_around))").alias("i"),
        F.least("d_before", "i_before").alias("shared"),
    )
    size = F.least(F.size("d"), F.size("i"))
    equal = line.withColumn("eq", F.zip_with("d", "i", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))).withColumn("size", size).withColumn("need", F.least(F.lit(min_overlap), F.col("i_words")))
    best = F.expr("array_max(transform(sequence(0, size - need), s -> aggregate(slice(eq, s + 1, need), 0, (a, x) -> a + x)))")
    return equal.where(F.col("size") >= F.col("need")).where(best >= F.ceil(F.col("need") * F.lit(min_share) - F.lit(1e-9))).select("doc_id", "doc_hash", "item_id", (F.col("at") - F.col("shared")).alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document that overlaps: ``doc_id, doc_hash, n_items, first_item, first_at``."""
    found = overlaps(docs, benchmark, **options)
    return found.groupBy("doc_id", "doc_hash").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.min("at").cast("long").alias("first_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, columns unchanged."""
    id_, hash_ = fresh(docs, "id", "hash")
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(id_), F.col("doc_hash").alias(hash_))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left_anti")


#: The same in SQL: seeds compared as word lists, windows counted one by one.
SQL = r"""
WITH masks(mask_no, ones) AS (VALUES (0, [1,2,3,4,5]), (1, [1,2,3,5,6]), (2, [1,2,4,7,8])),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, w FROM d WHERE len(w) >= 5),
bp AS (SELECT item_id, unnest(range(0, len(w) - 4)) AS pos, w FROM b WHERE len(w) >= 5),
ds AS (SELECT doc_id, pos, mask_no, list_transform(ones, lambda o: w[pos + o]) AS seed FROM dp, masks WHERE pos + list_max(ones) <= len(w)),
bs AS (SELECT item_id, pos, mask_no, list_transform(ones, lambda o: w[pos + o]) AS seed FROM bp, masks WHERE pos + list_max(ones) <= len(w)),
hits AS (SELECT DISTINCT ds.doc_id, ds.pos AS dpos, bs.item_id, bs.pos AS ipos FROM ds JOIN bs USING (mask_no, seed)),
wins AS (SELECT h.doc_id, h.item_id, h.dpos, h.ipos, d.w AS dw, b.w AS bw, least(13, len(b.w)) AS need, unnest(range(-12, 21)) AS s
         FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
ok AS (SELECT doc_id, item_id, dpos - least(12, dpos, ipos) AS "at" FROM wins
       WHERE dpos + s >= 0 AND ipos + s >= 0 AND s + need <= 20
         AND dpos + s + need <= len(dw) AND ipos + s + need <= len(bw)
         AND len(list_filter(range(1, need + 1), lambda k: dw[dpos + s + k] = bw[ipos + s + k])) >= ceil(need * 0.8 - 1e-9))
SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, CAST(min("at") AS BIGINT) AS first_at FROM ok GROUP BY doc_id
"""
