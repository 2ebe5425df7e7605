"""Seeded samples by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def golden_set(df: DataFrame, strata: list[str], stratum: str = "level", key: str = "id", size: int = 50, seed: str = "golden") -> DataFrame:
    """SRT12: df with place, of each stratum the ceil(size / number of strata) rows of the least seeded hash, the strata in order, size rows in all.

    The k least of a stratum are kept by each task before any row is shuffled, and again after, so a hot stratum costs k rows
    for each task. Rows of other strata are passed over, those without one are of the middle one; equal hashes go to the
    smaller key. Rows with equal keys are told apart by nothing and may be drawn both.
    """
    k = -(-size // len(strata))
    own = F.coalesce(F.col(stratum), F.lit(strata[len(strata) // 2]))
    order = F.array_position(F.array(*map(F.lit, strata)), own)
    drawn = df.withColumn("_order", order).where(F.col("_order") > 0).withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    drawn = drawn.withColumn("_nth", F.row_number().over(Window.partitionBy("_order").orderBy("_hash", key))).where(F.col("_nth") <= k)
    place = F.row_number().over(Window.orderBy("_order", "_nth"))  # k rows for each stratum
    return drawn.withColumn("place", place.cast("long")).where(F.col("place") <= size).drop("_order", "_hash", "_nth")
