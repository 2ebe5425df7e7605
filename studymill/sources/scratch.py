"""Scratch tables below the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Tables that stored() wrote since settled() began, if it has.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    made = tempfile.mkdtemp(prefix="studymill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet below the checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/studymill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """stored(make(), name), after which every table that was stored on the way is deleted: no later plan may read one of them."""
    on_the_way: list[DataFrame] = []
    before = _made.set(on_the_way)
    try:
        df = make()
    finally:
        _made.reset(before)
    out = stored(df, name)
    forget(*on_the_way)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that stored() wrote and that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_stored_at", None) if t is not None else None:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
