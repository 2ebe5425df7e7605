"""The pipeline stage by stage, each on its own input, and over an empty table."""

import hashlib
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from studymill.llm import quality
from studymill.llm.common import checkpoint_dir, default_tokenizer, gathered, stored
from studymill.llm.mixing import mix_plan
from tests.llm.conftest import corpus
from tests.llm.test_dedup import brute, windows


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus(5))]
    rows += [(1000 + i, "junk " * 300, "en", "s1", 1500) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages(spark, table):
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs.collect(), stored(stage(spark, docs, ""), name)
        assert out.columns == docs.columns, name
        after, texts = out.collect(), {r.doc_id: r.text for r in before}
        if name == "quality_classifier":
            assert {r.doc_id for r in after} <= set(texts)
            assert not any(r.doc_id >= 1000 for r in after) and all(i in {r.doc_id for r in after} for i in range(40))
        if name == "near_dedup":
            want = brute(list(texts.items()), 5)
            assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if c == i}
        if name == "substring_dedup":
            seen = {}
            for r in sorted(after, key=lambda r: r.doc_id):
                assert all(seen.setdefault(g, r.doc_id) == r.doc_id for g in windows(r.text))
        if name == "source_mix":
            assert Counter(r.doc_id for r in after) == Counter({r.doc_id: r.copies for r in mix_plan(docs).collect() if r.copies})
        docs = out
    tokenizers = pytest.importorskip("tokenizers")
    lib, texts = tokenizers.Tokenizer.from_file(default_tokenizer()), {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.bpe_stage(spark, docs, "").collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_an_empty_table_passes(spark, table):
    docs = table.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


def kept_tables(spark):
    """Names of the tables below the checkpoint folder, each with its number."""
    top = f"{checkpoint_dir(spark).removeprefix('file:')}/studymill/{spark.sparkContext.applicationId}"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_stages_keep_no_large_tables(spark, table):
    """What a stage stores on its way is gone before the texts move: features, sketches and runs of sentences."""
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, lazy = kept_tables(spark), stage(spark, docs, "")
        assert {re.sub("-.*", "", x) for x in kept_tables(spark) - before} <= {"gone", "rates"}, name
        docs = stored(lazy, name)


def test_run_keeps_the_last_table(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    before = kept_tables(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {re.sub("-.*", "", x) for x in kept_tables(spark) - before} == {"source_mix"} and out.count() > 0


def test_rejected_rows_are_named_by_id_and_text(spark, table):
    """Rows without id and two texts of one id: the classifier's verdict on each row decides."""
    more = [(None, "junk " * 300, "en", "s1", 1500), (None, None, "en", "s1", 0), (3, "junk " * 300, "en", "s1", 1500), (3, "", "en", "s1", 0)]
    docs = table.unionByName(spark.createDataFrame(more, table.schema)).unionByName(table.where("doc_id = 3").selectExpr("cast(null as long) doc_id", *table.columns[1:]))
    want = quality.scored(docs).where("quality_keep").select(*docs.columns).collect()
    got = corpus_pipeline.quality_stage(spark, docs, "").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) < docs.count()
    assert any(r.doc_id is None for r in got) and [r.text for r in got if r.doc_id == 3] == [r.text for r in table.where("doc_id = 3").collect()]


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_stage, corpus_pipeline.near_dedup_stage])
def test_narrow_tables_are_written_by_few_tasks(spark, table, stage):
    """Each file that a task writes may cost the executor a fork: a task a core, not one for each shuffle partition."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in conf}
    cores, before = spark.sparkContext.defaultParallelism, kept_tables(spark)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert gathered(spark.range(0, 100, 1, 24)).rdd.getNumPartitions() == max(cores, 24 // 5)
        n = stage(spark, table, "").count()
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    top = f"{checkpoint_dir(spark).removeprefix('file:')}/studymill/{spark.sparkContext.applicationId}"
    (gone,) = [x for x in kept_tables(spark) - before if x.startswith("gone-")]
    assert 0 < n < table.count() and len([x for x in os.listdir(f"{top}/{gone}") if x.startswith("part-")]) <= max(cores, 24 // 5)
