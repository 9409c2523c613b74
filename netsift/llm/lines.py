"""Line dedup by distinct-site spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, sized_broadcast, stash


def _lines(docs: DataFrame, site_col: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that is not blank: its hash, site, document and number."""
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    line = F.trim(F.col("line"))
    return split.select("id", "text_hash", "site", F.posexplode("lines").alias("no", "line")).where(F.length(line) > 0).select("id", "text_hash", "site", "no", F.xxhash64(line).alias("line_hash"))


def boilerplate(lines: DataFrame, *, min_sites: int, band: float, lg_k: int, max_broadcast: int) -> DataFrame:
    """``line_hash, sites, first_id, first_no``: lines that stand on ``min_sites`` or more distinct sites.

    A count of rows comes first, as a line on n sites has n rows. The sites of
    the rest are summed to one row a line and site before anything is dealt by
    line, so a line of very many documents is as many rows as it has sites.
    One HyperLogLog sketch per line hash is merged from these by the
    aggregation. Estimates within ``band`` of the threshold are near: those
    lines, and only those, get an exact distinct count. With ``lg_k`` of 10
    the sketch is exact or nearly so up to some hundreds of sites.
    """
    often = stash(lines.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "no")).alias("first")).where(F.col("n") >= min_sites), "often")
    mine = sized_broadcast(often.select("line_hash"), max_broadcast)
    spread = stash(lines.select("line_hash", "site").join(mine, "line_hash", "left_semi").groupBy("line_hash", "site").agg(F.count(F.lit(1)).alias("n")), "sites")
    sketched = spread.groupBy("line_hash").agg(F.hll_sketch_agg("site", lg_k).alias("sketch")).select("line_hash", F.hll_sketch_estimate("sketch").alias("estimate"))
    sketched = sketched.where(F.col("estimate") >= min_sites * (1 - band))
    near = sketched.where(F.col("estimate") <= min_sites * (1 + band)).select("line_hash")
    exact = spread.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.count(F.lit(1)).alias("exact"))
    sites = sketched.join(exact, "line_hash", "left").select("line_hash", F.coalesce("exact", "estimate").alias("sites")).where(F.col("sites") >= min_sites)
    return sites.join(often, "line_hash").select("line_hash", "sites", F.col("first.id").alias("first_id"), F.col("first.no").alias("first_no"))


def dedup_lines(docs: DataFrame, *, min_sites: int = 10, band: float = 0.3, lg_k: int = 10, max_broadcast: int = 500_000, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without cross-site boilerplate lines; all columns stay, only the text changes.

    A line (blanks at its ends apart) that stands on ``min_sites`` or more
    distinct sites is boilerplate. Its first occurrence, by smallest id and
    line number, stays, so that of many copies of a document one stays whole;
    all others go. With ``counts``, two columns are added: ``n_lines`` (not
    blank) and ``n_removed``; input columns of these names give way.

    Blank lines are never removed. Null texts stay null, empty texts empty.
    Null sites count together as one site; a null id comes before all others.
    Repeated rows change alike. An empty table stays empty. Columns of any
    other name pass through. Tables of lines are broadcast up to
    ``max_broadcast`` rows, beyond that joined by shuffle.
    """
    lines = _lines(docs, site_col, id_col, text_col)
    found = stash(boilerplate(lines, min_sites=min_sites, band=band, lg_k=lg_k, max_broadcast=max_broadcast), "boilerplate")
    if counts:
        docs = docs.drop("n_lines", "n_removed")
    id_, hash_, drops_ = fresh(docs, "id", "hash", "drops")
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("no") == F.col("first_no"))
    drops = lines.join(sized_broadcast(found, max_broadcast), "line_hash").where(~first).groupBy("id", "text_hash").agg(F.collect_set("no").alias("drops"))
    drops = drops.toDF(id_, hash_, drops_)
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left")
    split = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(drops_))
    kept = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    columns = [F.when(F.col(drops_).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        n_lines = F.coalesce(F.size(F.filter(split, lambda x: F.length(F.trim(x)) > 0)), F.lit(0))
        columns += [F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size(drops_), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, no - 1 AS no, parts[no] AS line
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS no FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))
),
b AS (
  SELECT trim(line, ' ') AS line, min((doc_id, no)) AS first FROM l
  WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10
),
k AS (
  SELECT l.doc_id, l.no, l.line, trim(l.line, ' ') <> '' AS full_line, b.line IS NOT NULL AND (l.doc_id, l.no) <> b.first AS gone
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line
)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
FROM k GROUP BY doc_id
"""
