"""Mixing sources to target weights (operator 5), by DataFrame functions alone.

Method: words are summed per source, each source's repetition rate is its target over its size, and each document is
emitted floor(rate) times, plus once more if its hash, seeded, falls below the rate's fraction.

Targets: sources in code-point order (null last) get the weights 5, 2, 1 in turn and share all words by weight; a target
stops at 3 times the size of its source, and what is above is shared again by weight until none is above. That is
water-filling, and has a closed form: with the sources in the order of cap over weight, the first whose share of what
the earlier caps leave doesn't exceed its own cap fixes the level of all later ones.

Defined results: a null text has size 0; documents of size 0 are taken 0 words, and emitted by the rate of their source
like others (a source without words has the rate 0); an empty table gives no rows; rows repeated exactly share their
hash, so all of them get the additional copy or none, and so do rows without id. Rates are found in windows over the
sources, in one task: a row of some 100 bytes for each source. Other columns are carried under names of their own and
given back as they were, so they can't clash; a very long text is counted where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, stored

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Sources up to which their rates are broadcast: at some 100 bytes each, 5 MB at most. More are joined by shuffling.
BROADCAST_SOURCES = 50_000


def source_rates(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate: one row for each source; sizes has source and size."""
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((place - 1) % n + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("share", left / heavy)
    fill = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", F.col("source").isNull(), "source", "share"))).over(total)
    s = s.withColumn("fill", fill["share"])
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("fill"), F.col("cap"))))
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def seeded(doc_id: str, seed: str = SEED):
    """A number in [0, 1) from the id: 52 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the columns of keep as kept_0, kept_1 and so on, one row for each document."""
    sized = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)))
    rates = stored(source_rates(sized.select("source", "size")), "rates").withColumnRenamed("source", "of")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    out = sized.join(rates, sized["source"].eqNullSafe(rates["of"]), "left")
    whole = F.floor("rate")
    out = out.withColumn("copies", (whole + (seeded("doc_id", seed) < F.col("rate") - whole).cast("long")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(f"kept_{k}" for k in range(len(keep))))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of df, each emitted as often as the mix takes it; the columns of df."""
    plan = mix_plan(df, doc_id, text, source, tuple(df.columns), seed).where("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(df.columns)))


def op5(spark, sf_dir):
    return mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS share
  FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(share, cap / w) FROM o WHERE share <= cap / w), cap)) AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
