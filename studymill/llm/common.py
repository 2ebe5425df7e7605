"""What several operators share: Arrow batches, scratch tables, word and hash rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studymill.sources.scratch import checkpoint_dir, forget, settled, stored  # noqa: F401 - the operators take them from here

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable]], schema: str, rows: int = 64) -> DataFrame:
    """Map each row to one output row in Python, over Arrow batches.

    ``make`` runs once in each task and returns ``f(*column_lists) -> list of output tuples``, which gets at most
    ``rows`` rows at a time, so that Python objects of only a few documents live at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = f(*(c.to_pylist() for c in part.columns))
                cols = list(zip(*got, strict=True)) if got else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(lean(run), schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the task's freed memory goes back to the system: workers are reused, and a memo would stay with them."""

    def f(batches):
        yield from run(batches)
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return f


def gathered(df: DataFrame) -> DataFrame:
    """df with several small shuffle partitions to a task: a fifth of the shuffle partitions, but a task a core at least.

    For narrow rows that are written or go to Python next: starting that costs a task more than its rows do. On a local
    file system without Hadoop's native library each file written also makes the executor fork for chmod.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 5))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Memo(dict):
    """A bounded memo of ``make``: two generations of at most ``cap`` entries each; keys over ``longest`` aren't kept."""

    def __init__(self, make: Callable, cap: int, longest: int = 64):
        super().__init__()
        self.make, self.cap, self.longest, self.old = make, cap, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Odd constants of the splitmix64 generator (fixed values).
MIX_GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x + np.uint64(MIX_GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of byte words, kept for the words seen lately."""

    def __init__(self, cap: int = 120_000):
        self.memo = Memo(xxhash.xxh3_64_intdigest, cap)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; the whole sequence as one run if it is shorter (none if it is empty)."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(MIX_A) + hashes[i : n - k + 1 + i]
    return mixed(out)


def unsigned_crc32(column) -> F.Column:
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, on the machine that asks; never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)
