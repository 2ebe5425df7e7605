"""Periodic runs of words (operator 11).

Method: bit-parallel lags. The words of a text are numbered; bit b of all numbers is one big integer, a plane with a bit
for each word. At lag p the planes are XORed with themselves shifted by p, and the ORed results have a zero wherever a
word equals the one p words on. Inverted, and ANDed with itself shifted by 1, 2, 4 and so on, what stays are the places
from which at least as many words match as a run of period p needs; each stretch of such places is one maximal run.

A stretch at lag p whose smallest period is q < p has length 4 p at least, so q divides p and the stretch is the run of q
itself: lags are taken in ascending order and a stretch found before isn't taken again.

Lags at which no run can lie aren't tried. A run of period p, 2^k <= p < 2^(k+1), matches over 3 p places at least (5 if p
is 1), and so over a whole block of 2^(k+1) places that starts at a multiple of 2^k. Hashes of all blocks, made by doubling,
tell for each such start at which of the 2^k lags its block stands again; blocks within a run of a period that divides the
lag are known already. That is n log n work for n words, and leaves as many lags as there are different periods, or nearly.

Defined results: null and empty texts, and texts of white space, have no runs and the empty text as collapsed text; rows
without id are read as they stand; repeated rows have equal results; one word is one run if it stands six times in a row;
ties between runs go to the smallest start, then period; the columns of the result are the given ones alone, so others of
the table can't clash; very long texts are held whole by one task, with a plane's bit for each word and bit of its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, documents, map_rows, mixed

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4


def numbered(words: list[bytes]) -> np.ndarray:
    """The number of each word among the different ones of the text."""
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit b of all numbers, as one big integer with the first word at bit 0."""
    return [int.from_bytes(np.packbits(ids >> b & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def places(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def runs_at(planes: list[int], n: int, p: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches in which words p apart are equal, LEAST words and TIMES periods long at least."""
    need = max(LEAST, TIMES * p) - p
    differ = 0
    for plane in planes:
        differ |= plane ^ plane >> p
    equal = ~differ & (1 << n - p) - 1
    have = 1  # equal's bits say that so many places match
    while have < need and equal:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    if not equal:
        return []
    first, last = places(equal & ~(equal << 1), n), places(equal & ~(equal >> 1), n)
    return list(zip(first.tolist(), (last - first + need + p).tolist(), strict=True))


def candidate_lags(block: np.ndarray, k: int, known: np.ndarray) -> list[int]:
    """Lags from 2^k to 2^(k+1) - 1 at which a block is repeated outside the known runs.

    block: hashes of the 2^(k+1) words from each place on; known: rows (start, length, period).
    """
    size = 1 << k
    rows = len(block) // size
    grid, rest = block[: rows * size].reshape(rows, size), block[rows * size :]
    start, past = np.nonzero(grid[:-1, :1] == grid[1:])
    if rows:
        at = np.flatnonzero(rest == grid[-1, 0])
        start, past = np.r_[start, np.full(len(at), rows - 1)], np.r_[past, at]
    lag, start = past + size, start * size
    known = known[known[:, 1] >= 3 * size]
    if len(known) and len(lag):
        known = known[np.argsort(known[:, 0], kind="stable")]
        near = np.searchsorted(known[:, 0], start, "right") - 1
        inside = np.zeros(len(lag), bool)
        for r in (near, near - 1):  # of the last two runs that begin before the block; another one only costs a lag that is tried in vain
            s, length, q = known[np.maximum(r, 0)].T
            inside |= (r >= 0) & (start + 2 * size + lag <= s + length) & (lag % q == 0)
        lag = lag[~inside]
    return np.unique(lag).tolist()


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, out, seen, planes, k = len(ids), [], set(), None, 0
    block, width = mixed(ids.astype(np.uint64)), 1
    while n >= max(LEAST, TIMES << k):
        while width < 2 << k:  # hashes of blocks twice as wide
            block = mixed(block[:-width] * np.uint64(MIX_A) + block[width:])
            width *= 2
        for p in candidate_lags(block, k, np.array(out, np.int64).reshape(-1, 3)):
            planes = planes or planes_of(ids)
            for run in runs_at(planes, n, p) if n >= max(LEAST, TIMES * p) else ():
                if run not in seen:
                    seen.add(run)
                    out.append((*run, p))
        k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: none does that a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edges[s + q] += 1
        edges[s + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period), collapsed: the text without the repeated periods.

    prepare, if given, makes the words that are searched of a document's id and words.
    """
    kind = dict(df.dtypes)[doc_id]

    def make():
        def one(i, t):
            words = (t or "").encode().split()
            if prepare:
                words = prepare(i, words)
            runs = find_runs(numbered(words)) if len(words) >= LEAST else []
            if runs:
                words = [words[k] for k in np.flatnonzero(kept_places(len(words), runs))]
            return i, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(words).decode()

        return lambda ids, texts: [one(i, t) for i, t in zip(ids, texts, strict=True)]

    return map_rows(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), make, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: one document in ten, by the hash of its id, ends in a periodic tail. Documents without id don't."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11(spark, sf_dir):
    found = periodic_runs(documents(spark, sf_dir), prepare=with_tail)
    # runs are in the order of the ties, so the first of the greatest exponents is the one
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(higher(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.when(F.col("best").isNotNull(), exponent).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
