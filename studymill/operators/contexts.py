"""What a question writer is given for each concept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studymill.functions.validation import clinical_support

#: Chunks of a context, characters of a passage; neighbours and their characters; associations among the facts (fixed values).
CHUNKS, PASSAGE, NEIGHBOURS, SNIPPET, ASSOCIATIONS = 4, 700, 2, 200, 3
#: Levels by importance, and for any other importance (fixed values).
LEVELS, OTHER_LEVELS = {"high": (1, 2, 3), "medium": (1, 2), "low": (1,)}, (1, 2)


def concept_contexts(concepts: DataFrame, own: DataFrame, found: DataFrame, near: DataFrame, chunks: DataFrame, guard: bool = True) -> DataFrame:
    """ALG24: (id, chunks, levels, facts, passages, neighbours) of each concept.

    concepts: id, importance, facts, relevance, associations; own: id, chunk, pos (the concept's own chunks in order); found: id,
    chunk, score (what a search for it gives); near: id, chunk, score (what a search for what it is confused with gives);
    chunks: chunk, text, start_page, end_page.

    The context is the concept's own chunks, then those found that aren't its own, the best first, CHUNKS in all. Level 3
    becomes level 2 if no chunk of it speaks of a clinical presentation. Candidates travel as ids; a task keeps the first
    CHUNKS of a concept before they are shuffled, and only these meet their texts. Ties go to the smaller chunk; chunks
    that aren't there are passed over; a concept without any has an empty context.
    """
    there = chunks.select("chunk")
    first = own.select("id", "chunk", F.lit(0).alias("kind"), F.col("pos").cast("double").alias("rank")).groupBy("id", "chunk").agg(F.min("kind").alias("kind"), F.min("rank").alias("rank"))
    more = found.join(own.select("id", "chunk"), ["id", "chunk"], "left_anti").groupBy("id", "chunk").agg(F.lit(1).alias("kind"), (-F.max("score")).alias("rank"))
    order = Window.partitionBy("id").orderBy("kind", "rank", "chunk")
    picked = first.unionByName(more).join(there, "chunk", "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CHUNKS)
    page = F.when(F.col("start_page") != F.col("end_page"), F.concat(F.lit("pages "), F.col("start_page").cast("string"), F.lit("–"), F.col("end_page").cast("string"))).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("start_page").cast("string"), F.lit("?"))))
    quoted = F.concat(F.lit('> "'), F.replace(F.substring("text", 1, PASSAGE), F.lit('"'), F.lit("'")), F.lit('" ['), page, F.lit("]"))
    # a chunk is read once; what travels to its concepts is a passage and a sign
    told = chunks.select("chunk", quoted.alias("passage"), clinical_support(F.col("text")).alias("clinical"))
    read = picked.join(told, "chunk").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk", "passage"))).alias("c"), F.max("clinical").alias("clinical"))  # CHUNKS rows at most
    best = near.groupBy("id", "chunk").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "chunk"))).where(F.col("place") <= NEIGHBOURS)
    beside = best.join(chunks.select("chunk", F.substring("text", 1, SNIPPET).alias("snippet")), "chunk").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "snippet"))).alias("n"))
    levels = F.lit(None)
    for importance, given in LEVELS.items():
        levels = F.when(F.col("importance") == importance, F.array(*map(F.lit, given))).otherwise(levels)
    levels = F.coalesce(levels, F.array(*map(F.lit, OTHER_LEVELS)))
    if guard:
        levels = F.when(F.coalesce("clinical", F.lit(False)), levels).otherwise(F.array_distinct(F.transform(levels, lambda x: F.when(x == 3, 2).otherwise(x))))
    facts = F.concat(F.coalesce("facts", F.array().cast("array<string>")), F.array("relevance"), F.slice(F.coalesce("associations", F.array().cast("array<string>")), 1, ASSOCIATIONS))
    none = F.array().cast("array<string>")
    out = concepts.join(read, "id", "left").join(beside, "id", "left")
    return out.select(
        "id", F.coalesce("c.chunk", F.array().cast(f"array<{dict(chunks.dtypes)['chunk']}>")).alias("chunks"), levels.alias("levels"), F.array_join(F.filter(facts, lambda x: x != ""), "; ").alias("facts"),
        F.array_join(F.coalesce("c.passage", none), "\n").alias("passages"), F.coalesce("n.snippet", none).alias("neighbours"),
    )
