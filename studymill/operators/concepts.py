"""Concepts: merging of inventories, and canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studymill.functions.text import coverage_domain, merge_key

def merged_inventory(concepts: DataFrame) -> DataFrame:
    """AGG25: concepts(pdf_id, pos, name, category, importance, facts, associations, relevance, chunk_ids) to one row for each key.

    The first occurrence names it; the importance is the highest; facts and associations are united, six at most; a
    relevance is appended unless its first 30 letters stand there already, and cut to 300; chunks are united.
    """
    rank = F.when(F.col("importance") == "high", 3).when(F.col("importance") == "medium", 2).otherwise(1)
    empty = F.array().cast("array<string>")
    row = F.struct("pos", "name", "category", rank.alias("rank"), F.coalesce("facts", empty).alias("facts"), F.coalesce("associations", empty).alias("associations"), F.coalesce("relevance", F.lit("")).alias("relevance"), F.coalesce("chunk_ids", empty).alias("chunk_ids"))
    log = concepts.withColumn("merge_key", merge_key(F.col("name"), F.coalesce("category", F.lit("")))).groupBy("pdf_id", "merge_key").agg(F.sort_array(F.collect_list(row)).alias("log"))
    union = lambda c, n=None: (lambda a: a if n is None else F.slice(a, 1, n))(F.array_distinct(F.flatten(F.transform("log", lambda x: x[c]))))

    def said(s, x):
        new = x["relevance"]
        there = F.contains(F.lower(s), F.substring(F.lower(new), 1, 30))
        return F.when((new == "") | (s != "") & there, s).when(s == "", new).otherwise(F.substring(F.concat(s, F.lit(" "), new), 1, 300))

    first = lambda c: F.get("log", F.lit(0))[c]
    top = F.array_max(F.transform("log", lambda x: x["rank"]))
    return log.select(
        "pdf_id", "merge_key", first("pos").alias("pos"), first("name").alias("name"), first("category").alias("category"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), top).alias("importance"),
        union("facts", 6).alias("facts"), union("associations", 6).alias("associations"), F.aggregate("log", F.lit(""), said).alias("relevance"), union("chunk_ids").alias("chunk_ids"), coverage_domain(first("name"), first("category")).alias("domain"),
    )


def prefix_of(name: Column) -> Column:
    """STR16 on a name without signs: its first word if that has over four letters, else the first two."""
    w = F.filter(F.split(F.regexp_replace(name, "[^a-zA-Z0-9 ]", ""), " "), lambda x: x != "")
    return F.lower(F.when(F.length(F.get(w, 0)) > 4, F.get(w, 0)).otherwise(F.array_join(F.slice(w, 1, 2), " ")))


def owners(merged: DataFrame) -> DataFrame:
    """(pdf_id, pos, owner): of each concept the first one of its category, itself owned by none, whose plain name holds its own or is held by it (four letters at least); itself if there is none.

    One fold over the names of a category of a document: a name either meets one kept before, or is kept.
    """
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    log = merged.groupBy("pdf_id", F.coalesce("category", F.lit("")).alias("kind")).agg(F.sort_array(F.collect_list(F.struct("pos", plain.alias("plain")))).alias("log"))
    state = "struct<kept:array<struct<pos:bigint,plain:string>>,owners:array<struct<pos:bigint,owner:bigint>>>"
    first = F.from_json(F.lit('{"kept":[],"owners":[]}'), state)

    def meet(s: Column, x: Column) -> Column:
        akin = F.get(F.filter(s["kept"], lambda k: (F.least(F.length(k["plain"]), F.length(x["plain"])) >= 4) & (F.contains(k["plain"], x["plain"]) | F.contains(x["plain"], k["plain"]))), 0)["pos"]
        kept = F.when(akin.isNull(), F.concat(s["kept"], F.array(x))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), F.concat(s["owners"], F.array(F.struct(x["pos"].alias("pos"), F.coalesce(akin, x["pos"]).alias("owner")))).alias("owners"))

    found = log.select("pdf_id", F.inline(F.aggregate("log", first, lambda s, x: meet(s, x).cast(state), lambda s: s["owners"])))
    return found.select("pdf_id", "pos", "owner")


def canonicalised(merged: DataFrame, per_prefix: int = 4) -> DataFrame:
    """ALG04: concepts under their owners, and of each prefix the best per_prefix; the best of a prefix takes in the facts and names of those beyond. The concepts of one document are few."""
    rank = F.when(F.col("importance") == "high", 3).when(F.col("importance") == "medium", 2).otherwise(1)
    rows = merged.withColumn("rank", rank).join(owners(merged), ["pdf_id", "pos"])
    log = rows.groupBy("pdf_id", "owner").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "category", "rank", "facts"))).alias("log"))
    lead = lambda c: F.get("log", 0)[c].alias(c)
    joint = lambda c: F.array_distinct(F.flatten(F.transform("log", lambda x: x[c])))
    taken = log.select(
        "pdf_id", lead("pos"), lead("name"), lead("category"), F.array_max(F.transform("log", lambda x: x["rank"])).alias("rank"), F.when(F.size("log") > 1, F.slice(joint("facts"), 1, 8)).otherwise(lead("facts")).alias("facts"),
        F.transform(F.slice("log", 2, F.size("log")), lambda x: x["name"]).alias("aliases"),
    )
    group = ["pdf_id", "prefix"]
    ranked = taken.withColumn("prefix", prefix_of(F.col("name"))).withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("rank"), "pos")))
    spare = ranked.where(F.col("k") > per_prefix).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("k", "name", "facts", "aliases"))).alias("spare"))
    kept = ranked.where(F.col("k") <= per_prefix).join(spare, group, "left")
    takes = (F.col("k") == 1) & F.col("spare").isNotNull()
    facts = F.when(takes, F.slice(F.array_distinct(F.concat("facts", F.flatten(F.transform("spare", lambda x: x["facts"])))), 1, 8)).otherwise(F.col("facts"))
    aliases = F.when(takes, F.concat("aliases", F.flatten(F.transform("spare", lambda x: F.concat(F.array(x["name"]), x["aliases"]))))).otherwise(F.col("aliases"))
    place = F.row_number().over(Window.partitionBy("pdf_id").orderBy("pos")) - 1
    return kept.select("pdf_id", place.cast("long").alias("place"), "name", "category", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank")).alias("importance"), facts.alias("facts"), aliases.alias("aliases"))
