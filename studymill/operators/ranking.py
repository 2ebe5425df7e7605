"""Ranks and quantiles of whole tables and of hot groups, without a task that holds all rows of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studymill.sources.scratch import stored

#: Rows of a table of offsets that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def checked(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """table, to be broadcast if it has no more than so many rows. It should be stored, as it is counted."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def ranked(df: DataFrame, order: list[Column], groups: tuple[str, ...] = (), name: str = "place", size: str | None = None) -> DataFrame:
    """df with each row's rank from 1 on within its group (in the whole table without groups), and the group's size.

    Rows are dealt by ranges of (groups, order), sorted and written with their number within the range. A range's rows of
    one group are a stretch, so a row of the small table of counts for each range and group gives the offsets; a group
    of any size is spread over ranges. order should tell all rows apart, or equal ones are ranked as they come.
    """
    columns = df.columns
    by = [F.asc_nulls_first(F.col(g)) for g in groups]
    # the range in the high bits, the place within it in the low 33
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_number", F.monotonically_increasing_id())
    placed = stored(placed.select("*", F.shiftright("_number", 33).alias("_part"), F.col("_number").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_number"), "ranges")
    counts = placed.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a row for each range of a group
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_of"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), (before - F.col("_first") + 1).alias("_offset"), F.sum("_n").over(own).alias("_all"))
    offsets = checked(stored(offsets, "offsets"))
    same = F.col("_part") == F.col("_of")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = placed.join(offsets, same)
    return out.select(*columns, (F.col("_offset") + F.col("_at")).alias(name), *([F.col("_all").alias(size)] if size else []))


#: Buckets into which a pass cuts what is left of a group's values.
BUCKETS = 1024


def values_at(df: DataFrame, wanted: DataFrame, group: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """(group, rank, value): the value of each wanted(group, rank), counted from 1 in ascending order.

    Each pass counts buckets of equal width between the least and the greatest value left, and goes on within the one
    that holds the rank, until it holds one value only. A task keeps a count for each bucket, however many values a
    group has. Nulls and values that aren't finite are passed over; ranks beyond the group give no row.
    """
    known = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and abs(v) < double('infinity')")  # NaN isn't smaller
    ends = known.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    left = wanted.select(F.col(group).alias("of"), F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("k")).join(ends, F.col("of").eqNullSafe(F.col("g"))).where("k between 1 and n")
    left = stored(left.select("of", "rank", "k", "lo", "hi"), "ranks")
    done = left.where("lo = hi").select("of", "rank", F.col("lo").alias("v"))
    left = left.where("lo < hi")
    while not left.isEmpty():
        met = known.join(checked(left), F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the difference of two doubles may be infinite
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        each = met.groupBy("of", "rank", "k", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("of", "rank").orderBy("bucket"))  # buckets rows at most
        each = each.withColumn("before", upto - F.col("n")).where("before < k and k <= before + n")
        step = stored(each.select("of", "rank", (F.col("k") - F.col("before")).alias("k"), "lo", "hi"), "ranks")
        done = done.unionByName(step.where("lo = hi").select("of", "rank", F.col("lo").alias("v")))
        left = step.where("lo < hi")
    return done.select(F.col("of").alias(group), "rank", F.col("v").alias(value))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): of an even number of values the mean of the two in the middle. Groups without finite values have no row."""
    sizes = df.where(F.abs(F.col(value).cast("double")) < float("inf")).groupBy(group).agg(F.count("*").alias("n"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    found = values_at(df, sizes.select(group, F.explode(middle).alias("rank")), group, value)
    return found.groupBy(group).agg((F.sum(value) / F.count("*")).alias("median"))
