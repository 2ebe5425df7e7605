"""Keyword and vector search against all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studymill.operators import retrieval


def plain_bm25(queries, texts, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    mean = sum(map(len, words.values())) / max(1, len(words))
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, terms in queries.items():
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(n * math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for t, n in terms.items() if tf[t])
            scores.append((-math.floor(s * 1e6 + 0.5) / 1e6, i))
        out += [(q, i, -s, place) for place, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("most", [1_000_000, 3])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_bm25_equals_all_pairs(spark, monkeypatch, most, k):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    rng = random.Random(k)
    vocabulary = [f"w{n}" for n in range(60)]
    word = lambda: vocabulary[min(int(rng.expovariate(0.12)), 59)]
    texts = {n: " ".join(word() for _ in range(rng.randint(0, 60))) for n in range(120)} | {500: None, 501: "", 502: "Étude W3, w3-w5!"}
    texts |= {600 + n: texts[n] for n in range(20)}
    queries = {q: Counter(word() for _ in range(rng.randint(1, 12))) for q in range(8)} | {90: Counter(["nowhere"]), 91: Counter(["w3", "nowhere"])}
    terms = spark.createDataFrame([(q, t, n) for q, ts in queries.items() for t, n in ts.items()], "query_id long, token string, qtf long")
    asked = spark.createDataFrame([(q,) for q in queries], "query_id long")
    chunks = spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()], "id long, text string, score double").repartition(5)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.bm25(asked, terms, chunks, k, most).collect()}
    want = plain_bm25(queries, texts, k)
    assert len(got) == len(want)
    for q, i, s, place in want:
        assert got[q, place][0] == i and got[q, place][1] == pytest.approx(s, abs=2e-6)


def vectors(rng, n, dim=24):
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.7
    x[3] = 0
    return x.astype(np.float32)


def test_nearest_is_exact_in_any_cells(spark):
    x = vectors(np.random.default_rng(1), 300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "id long, embedding array<float>")
    asked = df.where("id % 10 = 3").select("id")
    want = {}
    for q in range(3, 300, 10):
        s = retrieval.similarities(x[q : q + 1].astype(float), x.astype(float))[0]
        want[q] = sorted(((-s[i], i) for i in range(300) if i != q))[:5]
    for cells in ((16384, 4096), (50, 7)):
        got = {}
        for r in retrieval.nearest(df, asked, 5, *cells).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((-r.similarity, r.id))
        assert got == want


def test_recall_of_the_inverted_file(spark):
    x = vectors(np.random.default_rng(2), 3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    asked = df.where("id % 30 = 0").select("id")
    index, centres = retrieval.inverted_file(df, lists=50, sample=1000)
    assert index.count() == 3000 and len(centres) == 50
    pairs = lambda d: {(r.query_id, r.id) for r in d.collect()}
    exact = pairs(retrieval.nearest(df, asked, 8))
    assert len(exact & pairs(retrieval.nearest_by_lists(index, centres, asked, probes=20, cell_rows=20))) >= 0.9 * len(exact)
    assert pairs(retrieval.nearest_by_lists(index, centres, asked, probes=50)) == exact


def test_recall_of_the_query(spark):
    from studymill.plans import indexed

    sf = "/root/testdata/sf0.01"
    pairs = lambda d: {(r.query_id, r.id) for r in d.collect()}
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    got = pairs(indexed.list_search(spark, sf))
    asked = spark.createDataFrame([(q,) for q in {q for q, _ in got}], "id long")
    exact = pairs(retrieval.nearest(v, asked, 8))
    assert len(exact & got) >= 0.9 * len(exact)
