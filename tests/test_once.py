"""What a rule needs of a text is made once, and beginnings of texts give what the whole ones do."""

import re

import pytest
from pyspark.sql import functions as F

from studymill.functions import text as T
from studymill.functions import validation as V
from studymill.plans import forms, rules
from studymill.plans.plan import Plan
from studymill.sources.drafts import DRAFTS

C = F.col


def text_of(column) -> str:
    return str(column).replace("\\", "")


def test_drafts_split_their_source_twice(spark):
    """ALG18: once to align the quote and once to better it; each use of the aligned quote split it again."""
    x = text_of(V.repaired_draft(C("quote"), C("options"), C("answer"), C("clue"), C("explanation"), C("a"), C("source")))
    assert x.count("|n+") == 2


def test_sentences_are_made_plain_once(spark):
    """STR43: words of keywords met a sentence that was made plain for each of them."""
    x = text_of(V.better_sentence(C("source"), C("quote"), C("keywords")))
    assert x.count("[^a-z0-9]+") == 3  # keywords, a sentence, the quote


@pytest.mark.parametrize("name", ["fil14_discarded", "alg28_key_sweep"])
def test_conditions_stand_on_what_is_stored(spark, name):
    """FIL14, ALG28: no condition is evaluated at the scan of the documents with all rules put in."""
    plan = rules.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if re.match(r"^[\s:+-]*Filter", x)]
    assert filters and not any("lambda" in x or "regexp" in x for x in filters)


def test_signs_of_white_space(spark):
    assert all(re.fullmatch(T.S, x) for x in T.SPACES) and len(T.SPACES) == len(set(T.SPACES)) == sum(bool(re.fullmatch(T.S, chr(k))) for k in range(0x10000))
    texts = ["", " ", "a", "　A-b ﻿", "x .. y  z\n", "é İI", "a\x85b \x85", "--", "\U0001f600 a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.trimmed(C("t")).alias("trimmed"), T.plain(C("t")).alias("plain"), F.lower("t").alias("low"))
    for k, trimmed, plain, low in df.collect():
        assert trimmed == texts[k].strip(T.SPACES)
        assert plain == re.sub(f"^{T.S}+|{T.S}+$", "", re.sub(f"{T.S}+", " ", re.sub(f"(?!{T.S})[^a-z0-9]", " ", low)))


def test_beginnings_give_parts_of_drafts(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{chr(97 + k % 26)}{'x' * (k % 9)}" for k in range(400))
    texts = [None, "", " ", "A b c. D e? F", "No end here " * 200, long, long + ". Yes. No! Or", "." * 2000 + "One. Two. Three.", "12 34 " * 300 + "alpha beta gamma delta Epsilon zeta. Eta!", "a" * 990 + " bb " + "c" * 30 + " d", ("x" * 332 + " ") * 6, "S" + "t" * 998 + ". U v. W."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = lambda: sorted(map(tuple, Plan("SELECT id, source, HEAD(raw, 50) AS raw, a, b, c, d, s0, s1 FROM {draft_parts}", DRAFTS)(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    got = parts()
    monkeypatch.delitem(forms.FORMS, "draft_parts")
    assert len(got) == len(texts) and got == parts()


def test_places_are_found_where_texts_are(spark):
    """ALG07: the text of a chunk isn't joined to the drafts."""
    plan = rules.provenance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(plan) if "Join" in x)
    assert "Aggregate" in "".join(plan[:at]) and not any("instr(" in x for x in plan[:at])


def test_queries_meet_numbers_of_terms(spark):
    """MTH15: terms of a chunk are told apart before they meet the queries, as numbers."""
    plan = rules.keyword_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    distinct = [x for x in plan.splitlines() if "Aggregate [id#" in x]
    assert len(distinct) == 1 and "number#" in distinct[0] and "query_id" not in distinct[0] and "term#" not in distinct[0]


def test_fill_is_summed_with_the_scores(spark):
    """ALG27: the scores are made once, not a second time to see what fills up."""
    plan = rules.relevant_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "LeftAnti" not in plan
