"""Exact top-k search by inner product (operator 10).

Method: multi-resolution segment statistics. A vector is cut into segments; of each, the mean and the deviation are
kept. By the Cauchy-Schwarz inequality the inner product of two vectors is at most the sum, over the segments, of length
times (product of the means plus product of the deviations) - that is, their distance is at least the one with this
product. Pairs are tested from few segments to many, and only the survivors' products are computed, exactly.

Queries and rows meet in the cells of a grid: each row goes to the cells of its column, each query to those of its
line, so a task holds a bounded block of either and a query meets each row once. Each cell returns k rows for a query.

A row moves once for every CELL_QUERIES queries, a query once for every CELL_ROWS rows. Where the queries are a share of
the rows, both that and the comparisons grow with the square of the table, the movement with 1 / CELL_QUERIES of it.

Defined results: vectors that are null or hold a null or a component that isn't finite, and rows without id, take no
part; equal scores go to the smaller id; a query is never its own answer, nor are rows of its id; vectors of unequal
lengths are compared over the shorter length; of rows with one id the least vector counts (element by element), and is
the query's if any of them is one; scores beyond 64 bits stand at the greatest or the least long, and tie there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K = 256.0, 5
#: Rows and queries of a cell, on average.
CELL_ROWS, CELL_QUERIES = 16384, 4096
STEP = 1024
#: Integers up to this size are exact as doubles.
EXACT = float(1 << 53)


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length: their product bounds the inner product."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / n
    var = np.add.reduceat(x * x, cuts[:-1], axis=1) / n - mean * mean
    return np.hstack([mean * np.sqrt(n), np.sqrt(np.maximum(var, 0) * n)])


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products as long integers."""
    if a.size and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= EXACT:
        return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(p) * int(q) for p, q in zip(x, y)))) for x, y in zip(a, b)], dtype=np.int64)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, of the living pairs at least: one by one where they are few."""
    qi, xi = np.nonzero(alive)
    if len(qi) * 32 > alive.size:
        return a @ b.T
    out = np.full(alive.shape, -np.inf)
    out[qi, xi] = np.einsum("ij,ij->i", a[qi], b[xi])
    return out


def search_cell(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, ids, scores) of the k best rows of each query, and the number of exact products. x sorted by id."""
    dim, n_q = q.shape[1], len(q)
    levels = [s for s in (4, 8, 16, 32) if 2 * s <= dim // 2] or [1]
    q_stats, x_stats = [segment_stats(q, s) for s in levels], [segment_stats(x, s) for s in levels]
    best_s, best_i = np.full((n_q, k), np.iinfo(np.int64).min), np.full((n_q, k), -1)
    have = np.zeros(n_q, dtype=np.int64)
    tested = 0
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dim < EXACT  # then doubles are exact
    for at in range(0, len(x), STEP):
        part, stats = x[at : at + STEP], [v[at : at + STEP] for v in x_stats]
        low = np.where(have >= k, best_s[:, -1].astype(float), -np.inf)
        alive = q_ids[:, None] != ids[None, at : at + STEP]
        for a, b in zip(q_stats, stats):
            bound = products(a, b, alive)
            finite = low > -np.inf
            slack = np.where(finite, 1e-9 * (np.abs(np.where(finite, low, 0)) + np.abs(bound, where=np.isfinite(bound), out=np.zeros_like(bound)).max(initial=0)) + 1e-3, 0)
            alive &= bound >= (low - slack)[:, None]
        tested += int(alive.sum())
        if small:
            score = np.where(alive, products(q, part, alive), -np.inf)
            if score.shape[1] > k:  # less than the k-th best of this block can't be an answer
                low = np.maximum(low, np.partition(score, -k, axis=1)[:, -k])
            qi, xi = np.nonzero(alive & (score >= low[:, None]))
            got, xi = score[qi, xi].astype(np.int64), xi + at
        else:
            qi, xi = np.nonzero(alive)
            xi = xi + at
            got = np.concatenate([exact_products(q[qi[p : p + 65536]], x[xi[p : p + 65536]]) for p in range(0, len(qi), 65536)] or [np.empty(0, np.int64)])
        # the k best of the old and the new, ties to the smaller id
        all_q = np.concatenate([np.repeat(np.arange(n_q), k), qi])
        all_s, all_i = np.concatenate([best_s.ravel(), got]), np.concatenate([best_i.ravel(), xi])
        real = all_i >= 0
        all_q, all_s, all_i = all_q[real], all_s[real], all_i[real]
        order = np.lexsort((ids[all_i], -1 - all_s, all_q))  # -1 - s: no overflow at the least long
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        first = np.searchsorted(all_q, np.arange(n_q))
        rank = np.arange(len(all_q)) - first[all_q]
        top = rank < k
        best_s[:], best_i[:] = np.iinfo(np.int64).min, -1
        best_s[all_q[top], rank[top]], best_i[all_q[top], rank[top]] = all_s[top], all_i[top]
        have = np.bincount(all_q[top], minlength=n_q)
    r, c = np.nonzero(best_i >= 0)
    return q_ids[r], ids[best_i[r, c]], best_s[r, c], tested


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(256 x), shorter ones filled with zeros."""
    col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy()) if len(col) else np.empty(0, int)
    dim = max(1, int(size.max(initial=1)))
    out = np.zeros((len(size), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def top_k(df: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the column named by vec_id."""
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(F.col(embedding), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.where(usable).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    n, n_q = df.where(usable).agg(F.count("*"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()  # repeated ids make the cells smaller
    cols, lines = max(1, -(-n // cell_rows)), max(1, -(-n_q // cell_queries))
    cols = max(cols, min(32, n // 256 + 1))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mine = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    met = rows.select("id", "v", F.lit(False).alias("q"), mine(cols, 1).alias("col"), every(lines).alias("line")).unionByName(
        rows.where("q").select("id", "v", "q", every(cols).alias("col"), mine(lines, 2).alias("line"))
    )

    def cell(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        asks, there = (rows.sort_by("id") for rows in (table.filter(table["q"]), table.filter(pc.invert(table["q"]))))
        x, q = matrix(there["v"]), matrix(asks["v"])
        dim = max(x.shape[1], q.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1])))
        q_id, i, s, _ = search_cell(asks["id"].to_numpy(), wide(q), there["id"].to_numpy(), wide(x), k) if len(q) and len(x) else ([], [], [], 0)
        return pa.table({"query_id": pa.array(q_id, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    found = met.groupBy("col", "line").applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
