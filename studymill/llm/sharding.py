"""Sharding on a consistent-hash ring with bounded loads (operator 9).

Method: every shard has many virtual nodes on a ring of 65,536 places; a row's hash is its place, and the next virtual
node clockwise is its own. A shard takes rows up to its bound, places in ring order; rows that overflow a full shard
continue clockwise to the next virtual node of a shard with room. The bounds here are tight: the n rows over k shards
give bounds of floor(n / k) and, for the first n mod k shards, one more, so counts are at most one apart (the law
``rows``).

Only the counts of the 65,536 places reach the driver, a number that doesn't depend on the data; the ring is walked over
these counts, and each row finds its shard from its rank within its place. The rank is a window over one place.

Defined results: a null text has the size 8 and the CRC of no bytes; rows repeated exactly are counted as one group, so
even a hot repeated row is aggregated before it is shuffled; rows without id are placed like others; an empty table has
no rows. Only id and text are read and returned, so other columns can't clash; a very long text is measured and hashed where
it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, unsigned_crc32

PLACES, VIRTUAL, SHARDS = 1 << 16, 128, 24
#: Repetitions of one row that a task writes from one record.
RUN = 1 << 16


def ring(shards: int, virtual: int = VIRTUAL, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise; those of a shard don't depend on the number of shards."""
    import xxhash

    return sorted((xxhash.xxh3_64_intdigest(f"{s}/{v}") % places, s) for s in range(shards) for v in range(virtual))


def assign(counts: dict[int, int], shards: int, slack: float = 0.0, virtual: int = VIRTUAL, places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, slot of the first rank) of all runs of rows. slack 0: counts at most one apart; else bounds of (1 + slack) times the mean."""
    from bisect import bisect_left

    total, nodes = sum(counts.values()), ring(shards, virtual, places)
    room = [total // shards + (s < total % shards) if not slack else int((1 + slack) * total / shards) + 1 for s in range(shards)]
    at, out, over, taken = [p for p, _ in nodes], [], [], [0] * shards

    def take(place, rank, n, s):
        n = min(n, room[s])
        if n:
            out.append((place, rank, rank + n, s, taken[s]))
            room[s] -= n
            taken[s] += n
        return n

    for place in sorted(counts):
        k = bisect_left(at, place) % len(nodes)
        n = take(place, 0, counts[place], nodes[k][1])
        if n < counts[place]:
            over.append((place, n, counts[place] - n, k))
    after = list(range(1, len(nodes))) + [0]  # the next virtual node whose shard may have room, with paths halved
    for place, rank, n, k in over:
        while n:
            walked = []
            while not room[nodes[k][1]]:
                walked.append(k)
                k = after[k]
            for w in walked:
                after[w] = k
            m = take(place, rank, n, nodes[k][1])
            rank, n = rank + m, n - m
    return out


def shard(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of all rows."""
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long").alias("size"), unsigned_crc32(F.col(text)).alias("text_crc32"))
    rows = rows.withColumn("spot", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("place", F.pmod("spot", F.lit(PLACES)).cast("int"))
    counts = dict(rows.groupBy("place").count().collect())  # PLACES rows at most, whatever the input
    runs = spark.createDataFrame(assign(counts, shards, slack), "place int, first long, end long, shard int, slot long")  # at most PLACES + shards rows and their splits
    same = rows.groupBy("place", "spot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    order = Window.partitionBy("place").orderBy("spot", "doc_id", "size", "text_crc32")
    ranked = same.withColumn("begin", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    parts = ranked.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("part"))
    each = parts.select("*", F.explode(F.sequence(F.col("part"), F.least(F.col("part") + RUN, "n") - 1)).alias("copy")).withColumn("rank", F.col("begin") + F.col("copy"))
    runs = F.broadcast(runs.groupBy("place").agg(F.collect_list(F.struct("first", "end", "shard", "slot")).alias("runs")))
    own = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["end"]))[0]
    placed = each.join(runs, "place").withColumn("own", own)
    return placed.select("doc_id", "size", "text_crc32", F.col("own.shard").alias("shard"), (F.col("own.slot") + F.col("rank") - F.col("own.first")).alias("slot"))


def op9(spark, sf_dir):
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
