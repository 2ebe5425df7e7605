"""Queries over their whole tables, against brute force on small tables."""

import math
import re

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from studymill.functions import text as T
from studymill.plans import content

PARTS = [(i, f"{a} {b}", c, i % 50, f"Brand#{i % 5}") for i, (a, b, c) in enumerate([("red", "ring", "ECONOMY"), ("red", "ringlet", "ECONOMY"), ("old", "gear", "ASIA"), ("red", "ring", "ECONOMY"), ("blue", "ring", "SMALL"), ("hot", "spring", "AFRIC")], 5000)]
TEXTS = {7001: "One red two. One red two", 7002: "gears turning slowly " + "word " * 450, 7003: ""}


def tables(spark, sf_dir, texts=TEXTS, lang="en", asked=((0, "gears turning"), (90, "turning zebra"))):
    """Tables of a few rows whose ids are large."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{sf_dir}/{name}.parquet")
    put("part", PARTS, "p_partkey long, p_name string, p_type string, p_size int, p_brand string")
    put("region", [(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(i, 0, "SEG", f"Customer#{i}", 1.0) for i in (4990, 5001, 5030)], "c_custkey long, c_nationkey int, c_mktsegment string, c_name string, c_acctbal double")
    put("supplier", [(8, 0, "S8")], "s_suppkey long, s_nationkey int, s_name string")
    put("orders", [(9973 + 8, 4990)], "o_orderkey long, o_custkey long")
    spark.sql("SELECT 1L AS event_id, 8L AS user_id, 'click' AS event_type, 1.0D AS value, '{\"k\": 5}' AS props, TIMESTAMP '2024-01-01 00:00:00' AS ts").coalesce(1).write.mode("overwrite").parquet(f"{sf_dir}/events.parquet")
    put("documents", [(i, t, lang, "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", list(asked), "item_id long, text string")
    put("embeddings", [(i, 0, [float(i % 7 + 1), float(i % 3), 1.0]) for i in (0, 3, 100, 150, 900)], "vec_id long, label int, embedding array<float>")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    tables(spark, path)
    return path


@pytest.fixture
def rows(spark, small):
    return lambda name, sf_dir=small: sorted(tuple(r) for r in entry.queries()[name](spark, sf_dir).collect())


def levenshtein(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def test_name_containment(rows):
    want = [(a[0], b[0]) for a in PARTS for b in PARTS if a[0] < b[0] and a[2] == b[2] and (a[1] in b[1] or b[1] in a[1])]
    assert rows("joi16_name_containment") == sorted(want) and len(want) == 3


def test_association_peers(rows):
    want = [(a[0], b[0]) for a in PARTS for b in PARTS if a[0] != b[0] and a[1].split()[1] in b[1]]
    assert rows("joi18_association_peers") == sorted(want) and want


def test_nearest_topic(rows):
    want = []
    for p in PARTS:
        distance, key, name = min((levenshtein(p[2].upper(), n), k, n) for k, n in ((0, "AFRICA"), (1, "ASIA")))
        want += [(p[0], name, distance)] if distance <= 5 else []
    assert rows("joi17_nearest_topic") == sorted(want) and want


def test_array_membership(spark, tmp_path):
    tables(spark, str(tmp_path), {i: "x" for i in (10001, 10002, 10003, 10012, 20000)})
    want = [(p[0], d) for p in PARTS for d in (10001, 10002, 10003, 10012, 20000) if p[0] * 2 <= d <= p[0] * 2 + 2]
    assert sorted(tuple(r) for r in entry.queries()["joi12_array_membership"](spark, str(tmp_path)).collect()) == sorted(want) and want


def test_grants_and_sources(rows):
    assert rows("joi10_grants") == [(24, 499), (4990, 499), (5001, 500), (5030, 503)]
    assert [r[0] for r in rows("fil09_exists")] == [4990, 5001, 5030]
    assert [r[0] for r in rows("agg09_dashboard")] == [4990, 5001, 5030]


def test_bigrams(rows):
    want = {}
    for i, t in TEXTS.items():
        w = re.sub("[^a-z0-9 ]", " ", t.lower()).split()
        for a, b in zip(w, w[1:]):
            want[i, f"{a} {b}"] = want.get((i, f"{a} {b}"), 0) + 1
    assert rows("win05_bigrams") == sorted((*k, n) for k, n in want.items())


def test_keyword_scores_and_weights(rows):
    assert rows("mth15_keyword_score")[0] == (0, 7002, 2.0)
    assert 453 in {r[1] for r in rows("mth03_term_weight")}


def test_cosine_distances_of_all_queries(spark, small, rows):
    nearest = {(r[0], r[1]) for r in rows("mth02_cosine_distance")}
    assert {q for q, _ in nearest} >= {0, 100} and all(math.isfinite(r[2]) for r in rows("mth02_cosine_distance"))


def test_searches_take_all_queries(rows):
    assert {r[0] for r in rows("joi14_exact_knn")} == {0, 100, 900}
    assert {r[0] for r in rows("mth01_cosine")} == {0, 100, 900}
    assert {r[0] for r in rows("alg02_rrf")} == {0, 90, 100, 900}
    assert {r[0] for r in rows("alg01_hybrid")} == {0, 90}


def test_bm25_is_filled_by_zero_scores(rows):
    got = rows("joi15_bm25")
    score = next(r[2] for r in got if r[:2] == (0, 7002))
    assert score > 0 and [(r[1], r[2]) for r in sorted(got, key=lambda r: r[3]) if r[0] == 0] == [(7002, score), (7001, 0.0), (7003, 0.0)]
    assert {(r[0], r[1]) for r in rows("win08_rank_positions")} == {(q, d) for q in (0, 90) for d in TEXTS}
    assert [r[:2] for r in rows("alg27_relevant_chunks")] == sorted((q, d) for q in (0, 90) for d in TEXTS)


def test_evidence_of_changed_quotes_equals_brute_force(spark):
    text = "Cardiac output primarily depends on heart rate and stroke volume during exercise. Veins store most of the blood; arteries carry blood away from the heart"
    docs = spark.createDataFrame([(1, text), (2, "The liver stores glycogen."), (3, text.upper() + "!!"), (4, "")], "doc_id long, text string")
    quotes = ["Cardiac indeed output primarily depends on heart rate and stroke volume during exercise", "missing wholly here; veins store most of the blood; arteries carry blood away from the heart", "lungs never breathe water; " + "veins store most of the blood; arteries carry blood away from the heart; during exercise. veins store most of the blood; cardiac output primarily depends on heart rate", "Nothing of it stands anywhere in those texts", "glycogen stores liver veins", "ardiac output pr"]
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    e = T.evidence(F.col("quote"), F.col("text"))
    want = {tuple(r) for r in q.crossJoin(docs).select("item_id", "doc_id", e.alias("e")).where("e.type <> 'none'").select("item_id", "doc_id", "e.type", "e.confidence").collect()}
    assert {tuple(r) for r in content.evidence_found(q, docs).collect()} == want
    assert {r[2] for r in want} == {"exact", "normalized", "fuzzy"} and {0, 2, 5} <= {r[0] for r in want}


def test_evidence_query_finds_quotes_with_a_word_put_in(spark, tmp_path):
    line = "cardiac output primarily depends on heart rate and stroke volume during exercise of the body"
    tables(spark, str(tmp_path), {1: f"before {line} after"}, asked=[(1, line)])
    assert [r[:3] for r in entry.queries()["alg05_evidence"](spark, str(tmp_path)).collect()] == [(1, 1, "fuzzy")]


def test_stem_rules_see_whole_texts(spark, tmp_path):
    tables(spark, str(tmp_path), {1: "-" * 60 + " The heart", 2: "The heart pumps blood through the whole body. The lungs breathe air every day."})
    got = {r["doc_id"]: r for r in entry.queries()["str_stem_rules"](spark, str(tmp_path)).collect()}
    assert got[1]["slug"] == "the-heart" and got[2]["quote_fault"] == "several sentences"


@pytest.mark.parametrize("lang", ["fr", None])
def test_documents_of_any_language(spark, tmp_path, lang):
    stem = "le coeur pompe du sang vers les grandes arteres du corps humain"
    tables(spark, str(tmp_path), {10: stem, 20: stem}, lang)
    got = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert got("alg03_question_duplicates") == [(0, 20, 10, "fingerprint")]
    assert {r[0] for r in got("agg24_term_frequency")} == {10, 20}
    assert [r[:3] for r in got("joi13_candidate_pairs")] == [(10, 20, 1)]
