"""Language identification: held-out accuracy, spans of mixed texts, and the parts against plain readings."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from studymill.llm import language

SYLLABLES = {
    "aa": ["tho", "ing", "er", "wha", "ble", "shu"],
    "bb": ["ção", "lh", "oso", "ue", "êi", "par"],
    "cc": ["ung", "sch", "ei", "ü", "zer", "kt"],
    "gr": ["λο", "γος", "και", "θα", "ν", "μη"],
    "ru": ["что", "не", "ст", "ва", "щи", "ы"],
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def labelled_rows(rng, n=400):
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, prose(rng, lang, rng.randint(1, 60)).capitalize() + ". 42", lang))
    return rows + [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 34 !?", "cc"), (n + 3, prose(rng, "aa", 9), None), (None, prose(rng, "bb", 9), "bb"), (5, rows[5][1], rows[5][2])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 0.5, "x") for r in labelled_rows(random.Random(4))], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)


def test_held_out_accuracy_and_defined_results(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in language.op12(spark, str(tmp_path)).collect()]
    rows = {r.doc_id: r for r in table.collect()}
    assert len(got) == table.count()
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (None if i is None else zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if not any(map(str.isalpha, rows[i].text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    held = [r for r in got if r["held_out"] and rows[r["doc_id"]].lang and r["lang_pred"] != "und"]
    assert len(held) > 50 and sum(r["lang_pred"] == rows[r["doc_id"]].lang for r in held) >= 0.97 * len(held)
    assert len({str(r) for r in got if r["doc_id"] == 5}) == 1
    assert language.fit(table.where("false")).languages == []
    assert {r.lang_pred for r in language.identify(table, language.fit(table.where("false"))).collect()} == {"und"}
    assert language.identify(table.where("false"), language.fit(table)).count() == 0


def test_labels_and_ids_of_held_out_rows_are_no_inputs(spark, table, tmp_path):
    held = language.remainder(F.col("doc_id")) == 0
    other = table.withColumn("lang", F.when(held, F.lit("aa")).otherwise(F.col("lang")))
    results = []
    for k, t in enumerate((table, other)):
        t.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        results.append(sorted(map(tuple, language.op12(spark, str(tmp_path / str(k))).collect()), key=str))
    assert results[0] == results[1]


def test_spans_of_mixed_texts(spark, table):
    rng = random.Random(9)
    model = language.fit(table.where("lang is not null"))
    parts = [[(lang, prose(rng, lang, rng.randint(8, 900))) for lang in rng.sample(list(SYLLABLES), rng.randint(1, 4))] for _ in range(60)]
    texts = [" 1, ".join(t for _, t in p) for p in parts]
    names, scores, spans = language.labelled(texts, model)
    found = right = 0
    for p, text, name, score, got in zip(parts, texts, names, scores, spans, strict=True):
        truth, at = np.empty(len(text), object), 0
        for lang, t in p:
            truth[at : at + len(t)] = lang
            at += len(t) + 4
        letters = [k for k, c in enumerate(text) if c.isalpha()]
        mine = np.empty(len(text), object)
        for s in got:
            mine[s["start"] : s["end"]] = s["lang"]
        found += len(letters)
        right += sum(mine[k] == truth[k] for k in letters)
        share = {x: sum(mine[k] == x for k in letters) for x in SYLLABLES}
        assert share[name] == max(share.values()) and score == pytest.approx(share[name] / len(letters))
        assert len(got) <= 2 * len(p)
    assert right >= 0.98 * found


def plain_path(score, penalty):
    best, came = score[0].copy(), []
    for row in score[1:]:
        top = int(best.argmax())
        change = best[top] - penalty > best
        came.append(np.where(change, top, np.arange(len(best))))
        best = np.where(change, best[top] - penalty, best) + row
    out = [int(best.argmax())]
    for c in reversed(came):
        out.append(int(c[out[-1]]))
    return out[::-1]


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_path_in_blocks_equals_one_pass(block):
    rng = np.random.default_rng(block)
    for _ in range(30):
        sizes = rng.integers(1, 60, rng.integers(1, 12))
        score = rng.normal(size=(sizes.sum(), rng.integers(1, 6)))
        first = np.cumsum(sizes) - sizes
        got = language.best_path(score, first, 1.5, block)
        for a, n in zip(first, sizes, strict=True):
            want = plain_path(score[a : a + n], 1.5)
            value = lambda path: score[np.arange(a, a + n), path].sum() - 1.5 * (np.diff(path) != 0).sum()  # noqa: E731, B023
            assert value(got[a : a + n]) == pytest.approx(value(np.array(want)))


def plain_score(model, word, script):
    total = np.zeros(len(model.languages))
    marked = "\0" + word + "\0"
    for k, order in enumerate(language.ORDERS):
        for at in range(len(marked) - order + 1):
            run = marked[at : at + order]
            inner = run[1:-1] if order > 2 else run
            if not any(map(str.isalpha, run)) or (order > 2 and not inner.isalpha()) or (order == 1 and not run.isalpha()):
                continue
            h = order
            for c in run:
                h = (h * language.MIX_A + ord(c)) % 2**64
            total += model.logs[k][h * language.MIX_A % 2**64 >> 64 - language.BITS]
    return np.where(model.own[script], total / len(language.ORDERS), -1e4)


def test_scores_equal_a_plain_reading(table, monkeypatch):
    model = language.fit(table.where("lang is not null"))
    texts = ["a thoING schei", None, "", "oso. λογος x", "é" * 31 + " ing"]
    words = language.Words(texts)
    spelt = ["a", "thoing", "schei", "oso", "λογος", "x", "é" * 31, "ing"]
    names = list(language.SCRIPTS)
    want = [plain_score(model, w, names.index("Greek") + 1 if "λ" in w else names.index("Latin") + 1) for w in spelt]
    assert words.letters.tolist() == list(map(len, spelt))
    assert np.allclose(model.scores(words), want, atol=1e-4)
    for step in (1, 3, 7):
        monkeypatch.setattr(language, "BATCH", step)
        monkeypatch.setattr(language.Words.windows, "__defaults__", (step,))
        assert np.allclose(model.scores(words), want, atol=1e-4)


def test_long_runs_of_letters_are_cut():
    words = language.Words(["x" * 70 + " y", "漢" * 33])
    assert words.letters.tolist() == [32, 32, 6, 1, 32, 1] and words.doc.tolist() == [0, 0, 0, 0, 1, 1]
