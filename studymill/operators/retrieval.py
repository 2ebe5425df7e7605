"""Keyword and vector search: the k best of every query, by bounds and blocks instead of all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studymill.sources.scratch import forget, stored

#: BM25's parameters (fixed values).
K1, B = 1.5, 0.75
#: Rarest terms of a query, from whose documents the bound of its k-th score comes. Scores are rounded to 6 places.
LEAD, SLACK = 3, 1e-5
#: Rows of query terms that are broadcast; texts and queries of a block of scores.
QUERY_TERMS, BLOCK_TEXTS, BLOCK_QUERIES = 1_000_000, 256, 512
#: Rows and queries of a block of vectors, on average.
CELL_ROWS, CELL_QUERIES = 16384, 4096
#: The inverted file: lists, rows from which their centres are learnt, rounds of learning, and lists that a query reads.
LISTS, SAMPLE, ROUNDS, PROBES = 100, 16384, 12, 40


def rounded(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


def filled(best: DataFrame, queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """best(query_id, id, score) ranked, with documents of score 0, the smallest ids first, where a query has fewer than k."""
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    few = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(f"coalesce(n, 0) < {k}").select("query_id")
    first = ids.orderBy("id").limit(2 * k)  # fewer than k of these have a score, so k are left, or all there are
    fill = few.join(F.broadcast(first), how="cross").join(best, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return best.unionByName(fill).withColumn("rank", ranked).where(F.col("rank") <= k)


class Terms(dict):
    """The number of each query term, -1 of other words."""

    def __missing__(self, word):
        return -1


#: Signs that part words: all bytes but a-z and 0-9.
PARTS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def counted(texts: pa.Array, terms: Terms) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, the query terms that it has, how often) of each text, given in lower case."""
    out = []
    for t in texts.to_pylist():
        words = (t or "").encode("utf-8", "surrogatepass").translate(PARTS).split()
        found = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
        out.append((len(words), *np.unique(found[found >= 0], return_counts=True)))
    return out


def merged(best: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query of two lists (query, score, id), by score and then id."""
    q, s, i = (np.concatenate(c) for c in zip(best, new, strict=True))
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], s[keep], i[keep]


def bm25(queries: DataFrame, terms: DataFrame, chunks: DataFrame, k: int = 20, most: int = QUERY_TERMS) -> DataFrame:
    """JOI15: (query_id, id, score, rank), the k best documents of each query; ties to the smaller id, documents of score 0 fill up.

    queries: query_id; terms: query_id, token, qtf, of one or more letters and digits; chunks: id (a number), text.

    Texts stay where they are. The query terms are broadcast if there are no more than ``most`` rows of them. One pass counts
    documents, words and the documents of each term; a second one multiplies the texts' term impacts with the terms'
    counts in the queries, in blocks of texts and queries, and keeps the k best of each query. Only these are shuffled: k
    rows for each query and task. Larger query sets take bm25_by_bounds, over postings. Scores are rounded to 6 places.
    """
    asked = stored(terms.select("query_id", "token", F.col("qtf").cast("long").alias("qtf")), "terms")
    if asked.limit(most + 1).count() > most:
        return by_postings(queries, asked, chunks, k)
    got = asked.orderBy("query_id", "token").toArrow()
    tokens = sorted(set(got["token"].to_pylist()))
    number = Terms((t.encode(), n) for n, t in enumerate(tokens))
    names = pc.unique(got["query_id"])
    column = pc.index_in(got["query_id"], names).to_numpy()
    line, weight = np.array([number[t.encode()] for t in got["token"].to_pylist()], np.int64), got["qtf"].to_numpy().astype(float)
    n_terms, n_queries = len(tokens), len(names)
    lower = chunks.where("id is not null").select("id", F.lower("text").alias("text"))

    def sizes(batches):
        df, words, docs = np.zeros(n_terms, np.int64), 0, 0
        for x in batches:
            for n, found, _ in counted(x["text"], number):
                df[found] += 1
                words, docs = words + n, docs + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, n_terms)), pa.array(np.r_[docs, words, df])], ["what", "n"])

    total = lower.mapInArrow(sizes, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).toArrow()  # a row for each query term
    number_of = np.zeros(n_terms + 2)
    number_of[total["what"].to_numpy() + 2] = total["n"].to_numpy()
    docs, words, df = number_of[0], number_of[1], number_of[2:]
    idf, mean = np.log((docs - df + 0.5) / (df + 0.5) + 1), words / max(docs, 1)

    def search(batches):
        best = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64))
        blocks = []
        for lo in range(0, n_queries, BLOCK_QUERIES):
            here = (column >= lo) & (column < lo + BLOCK_QUERIES)
            m = np.zeros((n_terms, min(BLOCK_QUERIES, n_queries - lo)), np.float64)
            m[line[here], column[here] - lo] = weight[here]
            blocks.append((lo, m))
        floor = np.zeros(n_queries)
        for x in batches:
            for at in range(0, x.num_rows, BLOCK_TEXTS):
                part = x.slice(at, BLOCK_TEXTS)
                each = counted(part["text"], number)
                size = np.array([len(f) for _, f, _ in each])
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                found, tf = (np.concatenate([e[c] for e in each]) for c in (1, 2))
                length = np.repeat(np.array([n for n, _, _ in each]), size)
                impact = idf[found] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                own, ids = np.repeat(np.arange(part.num_rows), size), part["id"].to_numpy()
                for lo, m in blocks:
                    s = np.zeros((part.num_rows, m.shape[1]))
                    for d in some:
                        mine = slice(*np.searchsorted(own, [d, d + 1]))
                        s[d] = impact[mine] @ m[found[mine]]
                    s = np.floor(s * 1e6 + 0.5) / 1e6
                    d, q = np.nonzero((s > 0) & (s >= floor[lo : lo + m.shape[1]]))
                    best = merged(best, (q + lo, s[d, q], ids[d]), k)
                q, first = np.unique(best[0], return_index=True)
                full = np.diff(np.r_[first, len(best[0])]) == k
                floor[q[full]] = best[1][first[full] + k - 1]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), pa.array(best[2]), pa.array(best[1])], ["query_id", "id", "score"])

    found = lower.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(search, f"query_id {dict(asked.dtypes)['query_id']}, id long, score double")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = stored(found.withColumn("rank", ranked).where(F.col("rank") <= k).drop("rank"), "best")
    return filled(best, queries, chunks.where("id is not null").select("id"), k)


def by_postings(queries: DataFrame, terms: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """bm25_by_bounds() with postings made of the texts: the query terms' alone, each with its text's length."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", " "), " "), lambda w: w != "")
    read = chunks.where("id is not null").select("id", words.alias("words"))
    lengths = stored(read.select("id", F.size("words").cast("long").alias("len")), "lengths")
    used = terms.select("token").distinct()
    postings = read.select("id", F.explode("words").alias("token")).join(used, "token").groupBy("id", "token").agg(F.count("*").alias("tf"))
    postings = stored(postings, "postings")
    n = F.broadcast(lengths.agg(F.count("*").alias("n")))  # one row
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.join(n, how="cross").select("token", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return bm25_by_bounds(queries, terms, postings, idf, lengths, k)


def bm25_by_bounds(queries: DataFrame, terms: DataFrame, postings: DataFrame, idf: DataFrame, lengths: DataFrame, k: int = 20) -> DataFrame:
    """bm25() for query sets too large to be broadcast, by equi-joins alone.

    queries: query_id; terms: query_id, token, qtf; postings: id, token, tf; idf: token, idf; lengths: id, len.

    A posting's impact is what it adds to a score; the greatest one of a token, times its count in the query, bounds what the
    term can add. The documents of a query's rarest terms give k full scores, the least of which is a bound of the k-th
    one. Terms whose bounds together don't reach it can't bring a document in, so only the postings of the others are
    joined to the query; the rest of the scores is looked up for the documents that may still reach the bound. Scores are
    summed in any order and rounded to 6 places.
    """
    used = postings.join(terms.select("token").distinct(), "token", "left_semi").join(idf.select("token", "idf"), "token").join(lengths.select("id", "len"), "id")
    mean = lengths.agg((F.sum("len").cast("double") / F.greatest(F.count("*"), F.lit(1))).alias("mean_len"))  # one row
    used = used.join(F.broadcast(mean), how="cross")
    impact = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    used = stored(used.select("token", "id", impact.alias("impact")), "impacts")
    most = used.groupBy("token").agg(F.max("impact").alias("most"), F.count("*").alias("df"))
    asked = stored(terms.join(most, "token").select("query_id", "token", "qtf", (F.col("qtf") * F.col("most")).alias("bound"), "df"), "terms")

    def scores(some: DataFrame, name: str) -> DataFrame:
        return some.join(used, "token").groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("impact")).alias(name))

    def looked_up(pairs: DataFrame, some: DataFrame) -> DataFrame:
        """(query_id, id, more): what these terms add for these pairs."""
        return pairs.join(some, "query_id").join(used, ["token", "id"]).groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("more"))

    each = Window.partitionBy("query_id")
    lead = asked.withColumn("nth", F.row_number().over(each.orderBy("df", "token"))).where(F.col("nth") <= LEAD)
    first = scores(lead, "part").withColumn("nth", F.row_number().over(each.orderBy(F.desc("part"), "id"))).where(F.col("nth") <= k).select("query_id", "id")
    floor = looked_up(first, asked.select("query_id", "token", "qtf")).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("more")).otherwise(0.0).alias("floor"))
    upto = F.sum("bound").over(each.orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0))
    split = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    split = stored(split.withColumn("needed", upto >= F.col("floor")), "terms")
    rest = split.groupBy("query_id").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    likely = scores(split.where("needed"), "part").join(rest, "query_id").where(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "id", "part")
    likely = stored(likely, "likely")
    more = looked_up(likely.select("query_id", "id"), split.where("not needed").select("query_id", "token", "qtf"))
    whole = likely.join(more, ["query_id", "id"], "left").select("query_id", "id", rounded(F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score")).where("score > 0")
    ranked = F.row_number().over(each.orderBy(F.desc("score"), "id"))
    best = stored(whole.withColumn("rank", ranked).where(F.col("rank") <= k).drop("rank"), "best")
    forget(asked, likely)
    return filled(best, queries, lengths.select("id"), k)


# vectors ---------------------------------------------------------------------------------------------------------------


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    dim = len(col[0]) if len(col) else 1
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def similarities(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines, rounded to 6 places; 0 of a vector without length."""
    scale = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, np.floor(q @ x.T / scale * 1e6 + 0.5) / 1e6, 0.0)


def best_of_cells(met: DataFrame, k: int, *cell: str) -> DataFrame:
    """(query_id, id, similarity, place) from rows (id, v, q, the columns of cell): of each cell the rows with q false are searched for those with q true."""

    def search(t: pa.Table) -> pa.Table:
        asks, there = t.filter(t["q"]), t.filter(pc.invert(t["q"]))
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if asks.num_rows and there.num_rows:
            x, ids, who = matrix(there["v"]), there["id"].to_numpy(), asks["id"].to_numpy()
            q = matrix(asks["v"])
            for at in range(0, len(q), 256):
                s = similarities(q[at : at + 256], x)
                s[who[at : at + 256, None] == ids] = -np.inf
                if s.shape[1] > k:
                    low = np.partition(s, -k, axis=1)[:, -k]
                else:
                    low = np.full(len(s), -9.0)
                a, b = np.nonzero((s >= low[:, None]) & (s > -np.inf))
                order = np.lexsort((ids[b], -s[a, b], a))
                a, b = a[order], b[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                for c, v in zip(out, (who[at : at + 256][a[keep]], ids[b[keep]], s[a[keep], b[keep]]), strict=True):
                    c.append(v)
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "id", "similarity"), out, strict=True)})

    found = met.groupBy(*cell).applyInArrow(search, "query_id long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def every(n):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1) if isinstance(n, int) else n - 1))


def mine(n, seed: int):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n) if isinstance(n, int) else n).cast("int")


def vector_rows(vectors: DataFrame) -> DataFrame:
    return vectors.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("v"))


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 20, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """JOI14: (query_id, id, similarity, place), exactly the k rows most similar to each of asked(id), itself left out; ties to the smaller id.

    Rows and queries meet in the cells of a grid, each once, as two matrices. vectors: id, embedding, all of one length,
    ids told apart. Rows without id or vector take no part.
    """
    rows = vector_rows(vectors)
    queries = rows.join(asked.select("id").distinct(), "id", "left_semi")
    n, n_q = rows.count(), queries.count()
    cols, lines = max(1, -(-n // cell_rows), min(32, n // 512)), max(1, -(-n_q // cell_queries))
    met = rows.select("id", "v", F.lit(False).alias("q"), mine(cols, 1).alias("col"), every(lines).alias("line"))
    met = met.unionByName(queries.select("id", "v", F.lit(True).alias("q"), every(cols).alias("col"), mine(lines, 2).alias("line")))
    return best_of_cells(met, k, "col", "line")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def centres(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of the lists, by rounds of assigning vectors to the nearest one and taking the means."""
    x = unit(x)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        to = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        c = np.where((np.bincount(to, minlength=len(c)) > 0)[:, None], unit(sums), c)
    return c


def inverted_file(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """QRK12: ((id, v, list) of every row, the lists' centres). The centres are learnt from at most sample rows, which a hash picks; every row is in the list of its nearest centre."""
    rows = vector_rows(vectors)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    c = centres(matrix(some["v"]), lists) if some.num_rows else np.zeros((1, 1))

    def run(batches):
        for x in batches:
            if x.num_rows:
                to = (unit(matrix(pa.chunked_array([x["v"]]))) @ c.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([x["id"], x["v"], pa.array(to)], ["id", "v", "list"])

    return stored(rows.mapInArrow(run, f"id long, v {dict(rows.dtypes)['v']}, list int"), "lists"), c


def nearest_by_lists(index: DataFrame, c: np.ndarray, asked: DataFrame, k: int = 8, probes: int = PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, id, similarity, place): the k most similar rows among the probes lists that are nearest to the query; nearest() is the exact way. A list of over cell_rows rows is searched in several cells."""
    queries = index.join(asked.select("id").distinct(), "id", "left_semi").select("id", "v")

    def run(batches):
        for x in batches:
            if x.num_rows:
                near = np.argsort(-(unit(matrix(pa.chunked_array([x["v"]]))) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                cuts = pa.array(np.arange(x.num_rows + 1, dtype=np.int32) * near.shape[1])
                yield pa.RecordBatch.from_arrays([x["id"], x["v"], pa.ListArray.from_arrays(cuts, pa.array(near.ravel()))], ["id", "v", "lists"])

    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))  # a row for each list
    there = index.join(F.broadcast(sizes), "list").select("id", "v", F.lit(False).alias("q"), "list", mine(F.col("parts"), 3).alias("part"))
    asks = queries.mapInArrow(run, f"id long, v {dict(queries.dtypes)['v']}, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    asks = asks.join(F.broadcast(sizes), "list").select("id", "v", F.lit(True).alias("q"), "list", every(F.col("parts")).alias("part"))
    return best_of_cells(there.unionByName(asks), k, "list", "part")
