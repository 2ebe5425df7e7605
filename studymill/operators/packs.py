"""Pairs of a row and each id of a group, from packs of ids that are expanded last: pairs are neither shuffled nor buffered by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studymill.sources.scratch import stored

from .ranking import checked

#: Ids of a pack, about, and packs that are broadcast at most; more are joined by shuffle (fixed values).
PACK, BROADCAST_PACKS = 512, 4096


def packed(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, pack, ids): the ids of each group in packs by their hash, as often as they stand there; null ids and groups are left out."""
    known = rows.select(group, key).where(F.col(group).isNotNull() & F.col(key).isNotNull())
    n = known.groupBy(group).agg(F.ceil(F.count("*") / PACK).alias("n"))
    placed = known.join(n, group).select(group, F.pmod(F.xxhash64(key), "n").alias("pack"), key)
    return stored(placed.groupBy(group, "pack").agg(F.sort_array(F.collect_list(key)).alias("ids")), "packs")


def paired(asks: DataFrame, packs: DataFrame, group: str, name: str, keep: Column) -> DataFrame:
    """asks(group, ...) with each id of their group as name, where keep holds. Rows of one group are dealt by its packs, so a large group is many tasks' work."""
    met = stored(asks.join(packs.select(group, "pack"), group), "asked")
    n = max(4 * asks.sparkSession.sparkContext.defaultParallelism, met.count() // 40_000 + 1)
    rest = [c for c in asks.columns if c != group]
    dealt = met.repartition(n, group, "pack", *rest).sortWithinPartitions(group, "pack")
    return dealt.join(checked(packs, BROADCAST_PACKS), [group, "pack"]).select(*rest, F.explode("ids").alias(name)).where(keep)
