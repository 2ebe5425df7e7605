"""Classifiers on held-out labels, mixing, sharding and search against plain readings."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from studymill.llm import mixing, quality, sharding, topk, toxicity
from tests.llm.conftest import sentence


def test_quality_finds_junk_and_keeps_prose(spark, docs, empty):
    rng = random.Random(7)
    rows = []
    for k in range(300):
        prose = " ".join(sentence(rng) for _ in range(rng.randint(4, 20)))
        kind = k % 10
        junk = {0: " ".join(w for w in prose.split() for _ in range(20)), 1: " ".join(w + "###" for w in prose.split()), 2: " ".join(w.upper() + "!!" for w in prose.split() * 4), 3: " | ".join(prose.split())}
        rows.append((k, junk.get(kind, prose), kind > 3))
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(4)
    got = quality.scored(df).collect()
    assert sum(r.good and not r.quality_keep for r in got) <= 2
    assert sum(not r.good and r.quality_keep for r in got) <= 6
    assert quality.scored(empty).count() == 0
    edges = quality.scored(docs).collect()
    assert len(edges) == docs.count()
    assert all(not r.quality_keep for r in edges if not (r.text or "").split())


def test_toxicity_on_held_out_labels(spark, docs, empty):
    rng = random.Random(8)
    bad, rows = ["zqidiot", "zqmoron", "zqscum"], []
    for k in range(400):
        w = " ".join(sentence(rng) for _ in range(rng.randint(3, 12))).split()
        n = [0, 0, 0, 0, 0, 0, 0, 1, 4, 14][k % 10]
        for _ in range(n):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), n))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n > 0)) for i, _, n in rows if i < 250] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(df, labels).collect()}
    assert all(got[i].toxic == (n > 0) for i, _, n in rows if i >= 250)
    mean = lambda n: np.mean([got[i].expected_severity for i, _, m in rows if m == n])
    assert mean(0) < mean(1) < mean(4) < mean(14)
    assert toxicity.severity(docs, labels).count() == docs.count()
    assert not any(r.toxic for r in toxicity.severity(docs, labels.where("false")).collect())
    assert toxicity.severity(empty.select("doc_id", "text"), labels).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    out, free, total = {}, set(names), sum(sizes.values())
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing_reaches_its_targets(spark, docs, empty):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(1, 40), f"s{min(9, int(rng.expovariate(0.5)))}" if k % 50 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken, spread = targets(sizes), Counter(), Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        part = want[r.source] / sizes[r.source] % 1
        spread[r.source] += r.size**2 * part * (1 - part)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * spread[s] ** 0.5 + 1e-6 * want[s]
    mixed = Counter(r.doc_id for r in mixing.mix(df).select("doc_id").collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix_plan(df).collect() and sorted(mixing.mix_plan(df).collect()) == sorted(got)
    dotted = mixing.mix(df.withColumn("a.b", F.lit(3)))
    assert dotted.columns[-1] == "a.b" and dotted.select("`a.b`").distinct().collect()[0][0] == 3
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(docs).count() == docs.count() and mixing.mix(docs).columns == docs.columns


def test_shards_are_equal_and_gapless(spark, docs, empty):
    df = docs.select("doc_id", "text").unionByName(spark.range(1000, 1900).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")))
    got = sharding.shard(df, 24).collect()
    assert len(got) == df.count()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(empty).count() == 0
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(df.repartition(7), 24).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_a_bounded_ring_moves_little():
    rng = random.Random(1)
    counts = {p: rng.randint(0, 3) for p in range(0, sharding.PLACES, 7)}
    where = lambda k: {(p, r): s for p, a, b, s, _ in sharding.assign(counts, k, slack=0.25) for r in range(a, b)}
    old, new = where(24), where(25)
    assert old.keys() == new.keys() and len(old) == sum(counts.values())
    assert max(Counter(old.values()).values()) <= 1.25 * len(old) / 24 + 1
    assert sum(old[x] != new[x] for x in old) < 0.15 * len(old)


def test_search_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(0, 0.2, 20).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(30)]  # ties
    rows += [(2000, None), (2050, [None] * 20), (2100, [float("nan")] * 20), (2150, [float("inf")] + [0.0] * 19), (2200, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, cell_rows=64, cell_queries=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q))[:5]
        assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_of_repeated_ids_the_least_vector_counts(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.5, 9.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [3.0, 0.0])] * 40
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 50 == 0, k=3, cell_rows=2, cell_queries=1).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(50, 7, 128 * 256 + 9 * 256 * 256), (50, 8, 128 * 512)]


def test_search_with_large_integers():
    a = np.array([[2.0**40, 3.0], [1.0, 2.0**41]])
    assert topk.exact_products(a, a[::-1]).tolist() == [2**40 + 3 * 2**41] * 2


def test_word_pattern_is_ascii_white_space():
    assert re.findall(mixing.WORD, "a\x0bb\x1cc d e") == ["a", "b\x1cc d", "e"]


def test_expectation_maximisation_recovers_accuracies():
    """Simulated votes of labellers of known accuracies, which abstain at random."""
    rng = np.random.default_rng(3)
    n, m = 60_000, len(quality.LABELLERS)
    bad = rng.random(n) < 0.2
    sees, wrong = rng.uniform(0.25, 0.55, m), rng.uniform(0.002, 0.008, m)
    vote = (rng.random((n, m)) < np.where(bad[:, None], sees, wrong)).astype(int)
    vote[rng.random((n, m)) < 0.15] = 2
    patterns = Counter("".join(map(str, v)) for v in vote)
    posterior, accused, share = quality.estimate(sorted(patterns.items()))
    assert abs(share - 0.2) < 0.02
    assert np.abs(accused[1] - sees).max() < 0.03 and np.abs(accused[0] - wrong).max() < 0.004
    kept = np.array([posterior["".join(map(str, v))] < 0.5 for v in vote[:5000]])
    best = np.array([np.prod(np.where(v == 1, wrong, np.where(v == 0, 1 - wrong, 1))) * 0.8 > np.prod(np.where(v == 1, sees, np.where(v == 0, 1 - sees, 1))) * 0.2 for v in vote[:5000]])
    assert (kept == best).mean() > 0.98  # the decision of the true model


def test_long_words_count_in_full():
    read = quality.Reader()
    letters = read.signals("word " + "é" * 100)[0]
    assert letters[3] == 0 and read.signals("#" * 50 + "é" * 50)[0][3] == 0.5
    assert abs(read.signals("#" * 60_000 + "é" * 60_000)[0][3] - 0.5) < 1e-3


def test_ordinal_fit_equals_a_plain_optimiser():
    """The fitted probabilities are those of plain gradient descent on the written-out likelihood."""
    rng = np.random.default_rng(5)
    x = rng.random((300, 4)).astype(np.float32)
    y = np.digitize(x @ np.array([3.0, -2.0, 1.0, 0.0]) + rng.normal(0, 0.5, 300), [0.5, 1.2, 2.0])
    model = toxicity.Ordinal.fit(x, y, rounds=4000, ridge=1e-2)
    cost = [[0.5 / np.mean(y < k), 0.5 / np.mean(y >= k)] for k in (1, 2, 3)]

    def loss(w, t):
        total = 0.5e-2 * w @ w
        for k in range(3):
            p = 1 / (1 + np.exp(-(x @ w - t[k])))
            total -= np.mean(np.where(y > k, cost[k][1] * np.log(p), cost[k][0] * np.log(1 - p)))
        return total

    p = np.array([0.0, 0, 0, 0, 0, 1, 2])
    for _ in range(6000):
        z = 1 / (1 + np.exp(-((x @ p[:4])[:, None] - p[4:])))
        e = np.stack([np.where(y > k, cost[k][1], cost[k][0]) * (z[:, k] - (y > k)) for k in range(3)], axis=1) / len(y)
        p -= 0.5 * np.r_[x.T @ e.sum(axis=1) + 1e-2 * p[:4], -e.sum(axis=0)]
    assert abs(loss(model.weights, model.thresholds) - loss(p[:4], p[4:])) < 1e-3
    assert np.all(np.diff(model.thresholds) > 0)


def test_grades_are_out_of_sample():
    x = np.zeros((60, 2), np.float32)
    toxic = np.r_[np.zeros(30, int), np.ones(30, int)]
    x[30:, 0] = np.linspace(0.5, 3, 30)
    got = toxicity.graded(x, toxic, np.arange(60) % 5, np.ones(60, int))
    assert not got[:30].any() and set(got[30:]) == {1, 2, 3} and got[30] == 1 and got[59] == 3


def test_ring_walk_against_a_plain_walk():
    """Each overflowing row walks on by single steps; the operator's runs give the same shards."""
    rng = random.Random(2)
    counts = {p: rng.randint(1, 4) for p in rng.sample(range(sharding.PLACES), 700)}
    for slack in (0.0, 0.25):
        nodes, total = sharding.ring(6), sum(counts.values())
        room = [total // 6 + (s < total % 6) if not slack else int((1 + slack) * total / 6) + 1 for s in range(6)]
        want, late = {}, []
        for place in sorted(counts):
            k = next((i for i, (p, _) in enumerate(nodes) if p >= place), 0)
            for r in range(counts[place]):
                if room[nodes[k][1]]:
                    want[place, r] = nodes[k][1]
                    room[nodes[k][1]] -= 1
                else:
                    late.append((place, r, k))
        for place, r, k in late:
            while not room[nodes[k][1]]:
                k = (k + 1) % len(nodes)
            want[place, r] = nodes[k][1]
            room[nodes[k][1]] -= 1
        assert {(p, r): s for p, a, b, s, _ in sharding.assign(counts, 6, slack=slack) for r in range(a, b)} == want


def test_rows_law_moves_little():
    rng = random.Random(4)
    counts = Counter(rng.randrange(sharding.PLACES) for _ in range(100_000))
    where = lambda k: {(p, r): s for p, a, b, s, _ in sharding.assign(counts, k) for r in range(a, b)}
    old, new = where(24), where(25)
    assert sum(old[x] != new[x] for x in old) < 0.08 * len(old)  # 4 % must move


def test_features_beyond_the_columns_share_them():
    known = toxicity.known_features(list(range(10, 30)), columns=8)
    real, toxicity.features_of = toxicity.features_of, lambda w: [int(w)]
    try:
        assert [known[str(f)] for f in (10, 17, 18, 29, 99)] == [(0,), (7,), (18 % 8,), (29 % 8,), ()]
    finally:
        toxicity.features_of = real
