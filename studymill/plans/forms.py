"""Fixtures that Spark makes by a DataFrame program. Their shared SQL stays what DuckDB runs, and so tests the program."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studymill.functions.text import bound
from studymill.operators import hierarchy, ranking, retrieval, scheduling


def nearest(vectors: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ids divisible by 100, and those of benchmark items, search all rows."""
    asked = vectors.where("id % 100 = 0").select("id").unionByName(benchmark.select(F.col("item_id").cast("long").alias("id")))
    return retrieval.nearest(vectors, asked)


def ranked_users(attempts: DataFrame) -> DataFrame:
    """WIN09: the best and the worst 27 % of each document's users. The order from below is the reverse one."""
    share = attempts.groupBy("pdf_id", "user_id").agg(F.avg(F.when(F.col("is_correct"), 1.0).otherwise(0.0)).alias("pct"))
    r = ranking.ranked(share, [F.desc("pct"), F.asc("user_id")], ("pdf_id",), "down", "n")
    cutoff = F.greatest(F.lit(1), F.ceil(F.lit(0.27) * F.col("n")))
    return r.select("pdf_id", "user_id", (F.col("down") <= cutoff).alias("top"), (F.col("n") + 1 - F.col("down") <= cutoff).alias("bottom"))


def context_scores(terms: DataFrame, words: DataFrame) -> DataFrame:
    """What a chunk's words add for the concepts of its book. Books and words travel as one 64-bit hash of both."""
    key = F.xxhash64("book", "term").alias("key")
    asked = terms.select("id", key)
    found = words.select(F.col("id").alias("chunk"), "book", F.explode("ws").alias("term")).select(key, "chunk").groupBy("key", "chunk").agg(F.count("*").alias("tf"))
    met = asked.join(found, "key").groupBy("id", "chunk").agg(F.sum(F.col("tf") * 2.5 / (F.col("tf") + 1.5)).alias("score"))
    return met.select("id", "chunk", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


#: Words of a text that drafts quote at most, and the signs that are read first (fixed values).
QUOTED, BEGIN = 50, 1000


def draft_parts(documents: DataFrame) -> DataFrame:
    """The words and sentences with which a text begins; of raw no more than drafts use. A beginning of the text tells them if it holds more than are wanted, so that the last of these is whole; else the whole text is read."""
    d = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("source"))
    squeezed = lambda t: F.regexp_replace(t, "[ \t\n\r]+", " ")
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")

    def first(n: int, f) -> Column:
        return bound(f(F.substring("source", 1, BEGIN)), lambda x: F.slice(F.when(F.size(x) > n, x).otherwise(f(F.col("source"))), 1, n))

    ws = first(8, lambda t: words(F.regexp_replace(t, "[^A-Za-z]+", " ")))
    ss = first(2, lambda t: F.regexp_extract_all(squeezed(t), F.lit("[A-Z][^.!?]*[.!?]"), 0))
    d = d.select("id", "source", first(QUOTED, lambda t: words(squeezed(t))).alias("raw"), ws.alias("ws"), ss.alias("ss"))
    word = lambda k, other: F.coalesce(F.lower(F.get("ws", k)), F.lit(other))
    said = lambda k, other: F.coalesce(F.get("ss", k), F.lit(other))
    parts = [word(0, "alpha").alias("a"), word(3, "beta").alias("b"), word(5, "gamma").alias("c"), word(7, "delta").alias("d")]
    return d.select("id", "source", "raw", *parts, said(0, "No sentence of this kind is here.").alias("s0"), said(1, "Nor a second one.").alias("s1"))


#: fixture: (program, the fixtures and tables that it takes)
FORMS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "closure": (hierarchy.closure, ("decks",)),
    "deck_paths": (hierarchy.paths, ("closure", "decks")),
    "bm25": (retrieval.bm25, ("queries", "query_terms", "chunks")),
    "nearest": (nearest, ("vectors", "benchmark")),
    "ranked_users": (ranked_users, ("attempts",)),
    "draft_parts": (draft_parts, ("documents",)),
    "context_scores": (context_scores, ("context_terms", "context_words")),
    "sm2": (scheduling.fold, ("reviews",)),
}
