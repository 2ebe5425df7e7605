"""Which texts hold which strings: a positional index of hashed runs of characters instead of all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studymill.sources.scratch import forget, stored

from .ranking import checked

#: (least length, run of characters, window) of a kind of string, long ones first: of the runs in each window of a text the one
#: of the least hash is indexed, so a string that spans a window has an indexed run wherever it stands. Shorter strings
#: use every run.
KINDS = ((24, 8, 17), (12, 6, 7), (6, 6, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1))
#: Odd constants of a multiplicative hash and of the splitmix64 finaliser (fixed values).
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def kind_of(length) -> F.Column:
    """The number of the kind for strings of this length."""
    out = F.lit(None).cast("int")
    for k, (least, _, _) in reversed(list(enumerate(KINDS))):
        out = F.when(length >= least, k).otherwise(out)
    return out


def indexed_runs(points: np.ndarray, kind: int, seed: int = 0) -> np.ndarray:
    """Hashes of the indexed runs of a text, given as code points, each once."""
    _, size, window = KINDS[kind]
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, np.uint64((kind + 1) ^ (seed & 0xFFFFFFFFFFFFFFFF)))
    for k in range(size):
        h = h * np.uint64(STEP) + points[k : k + n].astype(np.uint64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(MIX_A)
    h = (h ^ h >> np.uint64(27)) * np.uint64(MIX_B)
    if window > 1:
        if n < window:
            return np.empty(0, np.int64)
        width = 1
        while width < window:  # least hash of windows, by doubling
            step = min(width, window - width)
            h = np.minimum(h[:-step], h[step:])
            width += step
    return np.unique(h).view(np.int64)


def run_rows(df: DataFrame, key: str, text: str, kinds: list[int], by: str | None = None) -> DataFrame:
    """(key, run, kind): the indexed runs of each text, for each of these kinds; for strings, of a text's own kind only. by: texts meet only texts of an equal value of this column."""
    own = kinds == []
    seed = F.xxhash64(F.col(by)) if by else F.lit(0).cast("long")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), seed.alias("seed"), kind_of(F.length(text)).alias("kind")).where("text is not null and kind is not null")
    type_of = dict(rows.dtypes)["key"]

    def run(batches):
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                runs, size, which = [], [], []
                for t, s, k in zip(part["text"].to_pylist(), part["seed"].to_pylist(), part["kind"].to_pylist(), strict=True):
                    points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    each = [indexed_runs(points, q, s) for q in ([k] if own else kinds)]
                    runs += each
                    size.append(sum(map(len, each)))
                    which += [np.full(len(e), q, np.int32) for e, q in zip(each, [k] if own else kinds, strict=True)]
                rows_of = np.repeat(np.arange(part.num_rows), size)
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(rows_of)), pa.array(np.concatenate(runs)), pa.array(np.concatenate(which))], ["key", "run", "kind"])

    return rows.mapInArrow(run, f"key {type_of}, run long, kind int")


def contained(needles: DataFrame, texts: DataFrame, needle_id: str = "needle_id", needle: str = "needle", text_id: str = "text_id", text: str = "text", by: str | None = None) -> DataFrame:
    """(needle_id, text_id) of all pairs in which the text holds the needle, character by character.

    Each needle looks up the one of its runs that the fewest texts have; what is found there is then tested. So a pair
    costs a row only if the text has that run, however many texts or needles there are; a run that many texts have is the
    rarest of a needle only if all its runs are common. Equal needles are looked up once, and so are equal texts if they are
    short; needles that are null or empty are held by no text here. by: a column of both tables, which must be equal.
    """
    extra = [by] if by else []
    asked = needles.where(F.length(needle) > 0).select(F.col(needle_id).alias("needle_id"), F.col(needle).alias("needle"), *extra)
    one = stored(asked.select("needle", *extra).distinct().withColumn("key", F.monotonically_increasing_id()), "needles")
    wanted = stored(run_rows(one, "key", "needle", [], by), "runs")
    kinds = sorted(r.kind for r in wanted.select("kind").distinct().collect())  # len(KINDS) at most
    if not kinds:
        return asked.select("needle_id").crossJoin(texts.limit(0).select(F.col(text_id).alias("text_id")))
    there = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"), *extra)
    used = checked(stored(wanted.select("run").distinct(), "used"), 1_000_000)
    found = stored(run_rows(there, "text_id", "text", kinds, by).select(F.col("key").alias("text_id"), "run").join(used, "run"), "found")
    often = found.groupBy("run").agg(F.count("*").alias("often"))
    rare = wanted.join(often, "run", "left").groupBy("key").agg(F.min_by(F.struct("run", "often"), F.struct(F.coalesce("often", F.lit(0)), "run")).alias("x")).where("x.often > 0").select("key", "x.run")
    met = stored(rare.join(found, "run").select("key", "text_id").distinct(), "met")
    forget(wanted, found)
    same = [F.col(by).eqNullSafe(F.col("text_by"))] if by else []
    tried = met.join(one, "key").join(there.select("text_id", "text", *([F.col(by).alias("text_by")] if by else [])), "text_id")
    held = tried.where(F.contains("text", "needle"))
    for c in same:
        held = held.where(c)
    held = held.select("key", "text_id").distinct()  # needles travel as numbers from here on
    on = F.col("needle") == F.col("sought")
    one = one.withColumnRenamed("needle", "sought")
    if by:
        one = one.withColumnRenamed(by, "sought_by")
        on &= F.col(by).eqNullSafe(F.col("sought_by"))
    return asked.join(one, on).select("needle_id", "key").join(held, "key").select("needle_id", "text_id")
