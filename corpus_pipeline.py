"""Corpus pipeline: documents of low quality go, near copies go, repeated passages go, sources are mixed, tokens are made.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet below the checkpoint folder
and rereads as the next one's docs. All stages but the last return the columns of documents. An empty table passes
through all stages. What a stage stores on its way (features, sketches, runs of sentences) is deleted before the texts
move: only which rows go, or what goes from them, is kept for that.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studymill.llm import bpe, mixing, near_dedup, quality, substring_dedup
from studymill.llm.common import forget, gathered, settled


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject. Equal texts have equal scores, so a rejected row is named by id and text."""
    key = ["doc_id", F.xxhash64("text").alias("text_hash")]
    scored = lambda: quality.scored(docs.select("text", *key), keep=["doc_id", "text_hash"])
    gone = settled(lambda: gathered(scored().where(~F.col("quality_keep")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: shingles of five words, similarity 0.8. Documents without id stay."""
    found = lambda: near_dedup.near_duplicates(docs, width=5, percent=80)
    gone = settled(lambda: gathered(found().where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated sentence spans; one of which nothing is left goes."""
    out = substring_dedup.dedup_substrings(docs, least=substring_dedup.LEAST)
    out = out.where((F.col("n_removed_words") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their source takes them."""
    return mixing.mix(docs)


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the tokens of each document that the mix took."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("source_mix", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trained weights, sketches and byte-pair merges aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
