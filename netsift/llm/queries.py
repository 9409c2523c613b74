"""One query for each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licences, lines, negatives, passages, ranked, repeats, simhash, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_paths() -> dict[str, str]:
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), **tokenizer_paths())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), label_col="toxic")
    return toxicity.score(docs, model)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out), label_col="quality")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_hash")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan_licences(table(spark, sf_dir, "documents")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label=moved)
    return negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("anchor_id")))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op9_passages": op9_passages,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op1_line_dedup": op1_line_dedup,
    "op3_topk": op3_topk,
    "op8_decontamination": op8_decontamination,
    "op10_html": op10_html,
    "op5_toxicity": op5_toxicity,
    "op7_quality": op7_quality,
    "op4_packing": op4_packing,
    "op11_licences": op11_licences,
    "op12_negatives": op12_negatives,
    "op13_ranked": op13_ranked,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.SQL,
    "op2_suffix_dedup": repeats.SQL,
    "op3_topk": topk.SQL,
    "op8_decontamination": decontamination.SQL,
    "op12_negatives": negatives.SQL,
    "op13_ranked": ranked.SQL,
}
