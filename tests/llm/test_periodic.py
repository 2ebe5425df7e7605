"""Periodic runs against a brute-force reading of their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from studymill.llm import periodic


def plain_runs(ids):
    """Every stretch at every lag, its smallest period by trial."""
    n, out = len(ids), set()
    for p in range(1, n // 4 + 1):
        k = 0
        while k < n - p:
            if ids[k] != ids[k + p]:
                k += 1
                continue
            end = k
            while end < n - p and ids[end] == ids[end + p]:
                end += 1
            length = end - k + p
            if length >= max(6, 4 * p) and not any(all(ids[i] == ids[i + q] for i in range(k, k + length - q)) for q in range(1, p)):
                out.add((k, length, p))
            k = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_ids(rng):
    out = []
    while len(out) < rng.randint(1, 150):
        kind = rng.random()
        if kind < 0.4:
            out += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 12))]
        else:
            unit = [rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randint(1, 14))]
            length = int(len(unit) * rng.uniform(1, 9))
            out += (unit * 9)[:length]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(1)
    hits = 0
    for _ in range(1500):
        ids = random_ids(rng)
        got = periodic.find_runs(np.array(ids))
        assert got == plain_runs(ids), ids
        hits += len(got) > 1
    assert hits > 300
    fib = [0]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    fib = b[:400]
    for ids in (fib, [0] * 200, [0, 1] * 100, ([0] * 7 + [1]) * 20, ([0] * 5 + [1]) * 20, [0] * 5, [0] * 6, [1, 2] * 3, [1, 2] * 4):
        assert periodic.find_runs(np.array(ids)) == plain_runs(ids)


def test_long_texts_of_one_period_try_few_lags():
    rng, calls = random.Random(2), []
    real = periodic.runs_at
    try:
        periodic.runs_at = lambda planes, n, p: calls.append(p) or real(planes, n, p)
        unit = [rng.randrange(1000) for _ in range(700)]
        assert periodic.find_runs(np.array(unit * 200)) == [(0, 140_000, 700)] and len(calls) < 10
        calls.clear()
        assert periodic.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)] and len(calls) < 10
    finally:
        periodic.runs_at = real


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(i, text, tail=True):
    words = (text or "").encode().split()
    if tail and i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
        g, n = zlib.crc32(str(i).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w.decode() for k, w in enumerate(words) if k not in gone)))


def test_query_equals_brute_force(spark, docs, empty, tmp_path):
    rng = random.Random(3)
    more = [(1000 + k, " ".join(f"w{x}" if k % 3 else "né"[: 1 + x % 2] + str(x) for x in random_ids(rng)), None, 1, "x", 0.0) for k in range(150)]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, periodic.op11(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(r.doc_id, r.text) for r in rows.collect()), key=str)
    assert len(got) == rows.count() and sum(g[1] > 0 for g in got) > 50
    assert periodic.periodic_runs(empty).count() == 0


def test_operator_returns_runs_and_text(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b end", "r"), (2, "  x  ", "r"), (3, None, "r")], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "a b end"
    assert got[2].runs == [] and got[2].collapsed == "x" and got[3].collapsed == ""
