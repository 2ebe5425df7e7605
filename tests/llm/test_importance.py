"""Importance resampling against a plain reading, and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from studymill.llm import importance


def features(text, width=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, width=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, width)[1]))
    for text in target:
        t.update(map(bucket, features(text, width)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        words, found = features(text, width)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = percent * sum(r[4] for r in out) // 100
    return sorted(((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(out)), key=str)


def target_of(rows):
    return [t for _, t, _ in rows[::5]] + [None, "", "Only Here 1 2"]


def test_query_equals_a_plain_reading_and_its_sql(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(target_of(rows))], "item_id long, text string, weight string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, importance.op13(spark, str(tmp_path)).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], target_of(rows))
    assert sum(r[4] is not None for r in got) >= 4
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert sorted(db.sql(importance.ORACLE).fetchall(), key=str) == got


def test_wider_features_fewer_buckets_all_drawn(spark, docs, rows):
    target = spark.createDataFrame([(t,) for t in target_of(rows)], "body string")
    got = importance.resample(docs, target, target_text="body", width=3, buckets=64, least=3, percent=50)
    assert sorted(map(tuple, got.collect()), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()], target_of(rows), 3, 64, 3, 50)


def test_no_target_no_rows_and_ties(spark, docs, empty):
    nothing = spark.createDataFrame([], "text string")
    got = sorted(map(tuple, importance.resample(docs, nothing).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [])
    assert importance.resample(empty, docs).count() == 0
    same = spark.range(4).select((F.col("id") % 2).alias("doc_id"), F.lit("one two three " * 9).alias("text"))
    got = importance.resample(same, nothing, percent=75).orderBy(F.asc_nulls_last("rank")).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in same.collect()], [], percent=75) and [r["rank"] for r in got] == [1, 2, 3, None]


def test_no_window_or_sort_of_all_rows(spark, docs):
    plan = importance.resample(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Nested" not in plan
