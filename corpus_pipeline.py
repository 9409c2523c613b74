"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents, whatever other columns there are.

In every stage a null text counts as empty, repeated rows are treated alike
(near-duplicate removal keeps one), null ids come before all others, and an
empty table stays empty. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netsift.llm import decontamination, lines, packing, simhash, toxicity
from netsift.llm.common import stash, table
from netsift.llm.queries import tokenizer_paths


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose expected severity reaches the threshold; empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), label_col="toxic")
    return toxicity.score(docs, model, keep=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines that many sources share, but for their first occurrence; no row goes, null texts stay null."""
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (runs of five words, similarity 0.8), that of the least id; all texts without words are one group."""
    return simhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages; texts of fewer than five words hold none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; an empty text is one closing token."""
    return packing.pack(docs, **tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokens, models and fingerprints are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
