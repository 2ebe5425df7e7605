"""Chunking, scheduling, question dedup, JSON repair and streams on small inputs."""

import random

import pytest

from studymill.functions.jsonrepair import repaired
from studymill.operators import chunking, concepts, dedup, scheduling
from studymill.streaming import states


def windows(words, size, overlap):
    step, out = size - int(size * overlap), []
    for i in range(0, len(words), step):
        end = min(i + size, len(words))
        far = min(end + 40, len(words))
        while end < far and words[end - 1][-1] not in ".?!":
            end += 1
        if end - i >= 20:
            out.append(" ".join(words[i:end]))
        if end >= len(words):
            break
    return out


def test_word_windows_equal_a_plain_loop(spark):
    rng = random.Random(1)
    docs = {k: [rng.choice(["alpha", "beta", "gamma.", "delta"]) for _ in range(n)] for k, n in enumerate([0, 5, 19, 20, 21, 60, 61, 99, 100, 101, 150, 333])}
    rows = [(k, p, " ".join(w[p * 40 : p * 40 + 40])) for k, w in docs.items() for p in range(len(w) // 40 + 1)]
    got = chunking.word_windows(spark.createDataFrame(rows, "pdf_id long, page int, text string"), 60, 0.15).orderBy("pdf_id", "chunk").collect()
    for k, w in docs.items():
        mine = [r for r in got if r.pdf_id == k]
        assert [r.text for r in mine] == windows(w, 60, 0.15)
        assert [r.chunk for r in mine] == list(range(len(mine)))
        assert all(r.start_page <= r.end_page and r.word_count == len(r.text.split()) for r in mine)


def structural(spark, lines, size=100):
    pages = {}
    for p, t in lines:
        pages.setdefault(p, []).append(t)
    df = spark.createDataFrame([(1, p, "\n".join(t)) for p, t in pages.items()], "pdf_id long, page int, text string")
    return chunking.structural_chunks(df, size, 0.15).orderBy("chunk").collect()


def test_structural_chunks_follow_headings(spark):
    lines = [(1, "HEART FAILURE")] + [(1, "word " * 30 + "end.")] * 2 + [(2, "Renal Blood Flow")] + [(2, "other " * 50 + "end.")]
    assert [(r.text.split()[0], r.start_page, r.end_page) for r in structural(spark, lines)] == [("HEART", 1, 1), ("Renal", 2, 2)]


def test_structural_chunks_overwrite_a_short_pending_text(spark):
    got = structural(spark, [(1, "SHORT"), (1, "a b c"), (1, "LONG"), (1, "word " * 120)])
    assert len(got) == 1 and got[0].text.startswith("LONG") and got[0].word_count == 121


def test_structural_chunks_break_at_blank_lines_and_cut_windows(spark):
    lines = [(1, "one " * 25), (1, "two " * 25), (1, "three " * 25), (1, ""), (2, "four " * 10), (2, ""), (2, "FIVE SIX"), (3, "seven " * 230)]
    got = structural(spark, lines)
    assert [(r.text.split()[0], r.start_page, r.end_page, r.word_count) for r in got] == [("one", 1, 2, 85), ("FIVE", 2, 3, 100), ("seven", 2, 3, 100), ("seven", 2, 3, 62)]


def test_sm2_step_by_step(spark):
    log = [(1, 1, q, k, k) for k, q in enumerate([3, 4, 4, 1, 3, 3, 2])]
    r = scheduling.fold(spark.createDataFrame(log, "user_id long, question_id long, quality int, reviewed_at long, id long")).first()
    state = (0, 0.17, 2.5, 0)
    for q in [3, 4, 4, 1, 3, 3, 2]:
        state = states.after(state, q)
    assert (r.turns, r.repetitions) == (state[0], state[3]) and abs(r.ease - state[2]) < 1e-9 and r.interval_days == state[1]


QUESTIONS = "user_id long, id long, concept_id long, level int, importance string, times_reviewed long, next_review long, last_reviewed long"
MASTERY = "user_id long, concept_id long, status string, overall long, target_level int, importance string"


def test_queue_orders_and_excludes(spark):
    q = lambda i, c, seen=0, nxt=None, last=None, lv=1: (7, i, c, lv, "high" if c == 1 else "low", seen, nxt, last)
    qs = spark.createDataFrame([q(1, 1, 3, 5, 4), q(2, 1), q(3, 2, 2, 1, 1), q(4, 3), q(5, 4, 1, 100, 9), q(6, None, 1, 2, 3), q(8, None, 1, 3, 2), q(9, None, 1, 4, 1)], QUESTIONS)
    ms = spark.createDataFrame([(7, 3, "weak", 10, 1, "low"), (7, 4, "mastered", 95, 1, "low")], MASTERY)
    got = scheduling.study_queues(qs, ms, now=10).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(got)))
    assert {(r.question_id, r.bucket, r.stands_for) for r in got} == {(2, "srs", 1), (3, "srs", None), (4, "weak", None), (9, "srs", 6), (6, "srs", 8), (8, "srs", 9)}
    assert got[-1].bucket == "weak"


def test_queues_equal_a_plain_reading(spark):
    """Every rule by its definition over random questions: who may stand where, and how many."""
    rng = random.Random(5)
    rows, mastery = [], []
    for u in range(4):
        for i in range(90):
            seen = rng.random() < (0.5 if u else 0.9)
            rows.append((u, i, rng.choice([None, *range(12)]), rng.randint(1, 3), rng.choice(["high", "medium", "low", None]), int(seen), rng.randint(0, 20) if seen else None, rng.randint(0, 9) if seen else None))
        mastery += [(u, c, rng.choice(["weak", "new", "medium", "strong", "mastered"]), rng.randint(0, 99), rng.randint(1, 3), rng.choice(["high", "medium", "low"])) for c in range(12)]
    got = scheduling.study_queues(spark.createDataFrame(rows, QUESTIONS), spark.createDataFrame(mastery, MASTERY), now=10).collect()
    for u in range(4):
        mine, q = {r.question_id: r for r in got if r.user_id == u}, {r[1]: r for r in rows if r[0] == u}
        due = sorted((r[6], i) for i, r in q.items() if r[5] and r[6] <= 10)
        length = 28 if len(due) <= 11 else max(28, len(due) + 20)
        taken, stands = set(), {}
        for _, i in due[: 11 if len(due) <= 11 else 200]:
            near = [(r[7] or 0, j) for j, r in q.items() if r[2] == q[i][2] and j != i and j not in taken]
            pick = min(near)[1] if near else i
            if pick not in taken:
                taken.add(pick)
                stands[pick] = i if pick != i else None
        kept = {i: r for i, r in mine.items() if r.bucket == "srs"}
        assert set(kept) <= set(stands) and all(r.stands_for == stands[i] for i, r in kept.items())
        assert len(kept) == min(length, len(stands)) and len(mine) <= length
        rank = {"high": 3, "medium": 2, "low": 1}
        weak = sorted((m for m in mastery if m[0] == u and m[2] in ("weak", "new")), key=lambda m: (-rank[m[5]], m[3], m[1]))[:9]
        fit = {(m[1], m[4]) for m in weak}
        for i, r in mine.items():
            assert (r.bucket == "srs") == (i in taken)
            if r.bucket == "weak":
                assert (q[i][2], q[i][3]) in fit and (not q[i][5] or q[i][6] <= 10)
            if r.bucket == "medium":
                assert q[i][3] in (2, 3)
            if r.bucket == "new":
                assert not q[i][5] and not any(m[1] == q[i][2] and m[2] == "mastered" for m in mastery if m[0] == u)
        order = [r.bucket for r in sorted(mine.values(), key=lambda r: r.place)]
        assert order == sorted(order, key=["srs", "weak", "medium", "new"].index)


def test_question_dedup_keeps_the_important_one(spark):
    stem = "Veins store large blood volumes because compliance permits distension under pressure changes quickly"
    rows = [(1, 1, stem, 2, "medium", None, [1.0, 0.0]), (1, 2, stem.replace("quickly", "slowly"), 2, "high", None, [0.98, 0.02]), (1, 3, "Nothing alike here", 2, "low", None, [0.0, 1.0]), (2, 4, stem, 2, "low", None, None)]
    df = spark.createDataFrame(rows, "bank long, id long, stem string, level int, importance string, chunk_id string, embedding array<float>")
    assert [tuple(r) for r in dedup.duplicates(df).collect()] == [(1, 1, 2, "embedding")]


def test_dropped_questions_drop_no_other():
    assert dedup.eliminated({1: (1, 2, ""), 2: (1, 2, ""), 3: (3, 1, ""), 4: (4, 2, "")}, [(2, 3), (3, 4)]) == [(2, 1, "fingerprint"), (3, 4, "embedding")]


@pytest.mark.parametrize("text,want", [
    ("```json\n[{\"a\": 1}]\n```", '[{"a":1}]'),
    ("[{a: 1,}]", '[{"a":1}]'),
    ("[{'a': 'x'}]", '[{"a":"x"}]'),
    ("Here it is: [{\"a\": 1}] thanks", '[{"a":1}]'),
    ("[{\"a\": 1}, {\"b\": [1, 2", '[{"a":1},{"b":[1,2]}]'),
    ("[{\"s\": \"say \"hi\" now\"}]", '[{"s":"say \\"hi\\" now"}]'),
    ("no array", None), (None, None), ("", None),
])
def test_json_repair(text, want):
    assert repaired(text) == want


def test_siblings_also_review_the_original(spark):
    rows = [(1, 10, 11, 3, 1, 1), (1, 10, 11, 2, 2, 2), (1, 12, None, 4, 3, 3)]
    got = states.proxied(spark.createDataFrame(rows, "user_id long, question_id long, proxied_from_id long, quality int, reviewed_at long, id long"))
    assert sorted((r.question_id, r.counts) for r in got.collect()) == [(10, True), (10, True), (11, False), (12, True)]


def test_latest_states(spark):
    rows = [(1, 1, 10, "a", 5), (1, 2, 20, "b", 0), (2, 1, 5, "c", None)]
    got = states.latest_states(spark.createDataFrame(rows, "job_id long, seq long, pct long, phase string, metric long"))
    assert sorted(map(tuple, got.collect())) == [(1, 20, "b", 2, 5), (2, 5, "c", 1, None)]


def test_inventories_merge_by_key(spark):
    schema = "pdf_id long, pos long, name string, category string, importance string, facts array<string>, associations array<string>, relevance string, chunk_ids array<string>"
    rows = [(1, 0, "Left Ventricle", "Heart", "low", ["a", "b"], None, "pumps", ["c1"]), (1, 1, "left-ventricle", "heart 2", "high", ["b", "c", "d", "e", "f", "g"], ["x"], "Pumps blood", ["c2", "c1"]), (1, 2, "Other", None, None, None, None, None, None)]
    got = {r.pos: r for r in concepts.merged_inventory(spark.createDataFrame(rows, schema)).collect()}
    assert (got[0].name, got[0].importance, got[0].facts, got[0].associations, got[0].chunk_ids) == ("Left Ventricle", "high", list("abcdef"), ["x"], ["c1", "c2"])
    assert got[0].relevance == "pumps Pumps blood" and got[2].importance == "low" and got[2].facts == []
    assert concepts.canonicalised(concepts.merged_inventory(spark.createDataFrame(rows, schema))).count() == 2


def canonical(spark, rows):
    schema = "pdf_id long, pos long, name string, category string, importance string, facts array<string>"
    df = spark.createDataFrame([(1, k, n, c, i, [n]) for k, (n, i, c) in enumerate(rows)], schema)
    return concepts.canonicalised(df).orderBy("place").collect()


def test_canonical_names_absorb_and_cap(spark):
    got = canonical(spark, [("Gastric ulcer", "low", "x"), ("ulcer", "high", "x"), ("Gastric ulcer", "low", "y")])
    assert [(g.name, g.importance, g.aliases) for g in got] == [("Gastric ulcer", "high", ["ulcer"]), ("Gastric ulcer", "low", [])]
    got = canonical(spark, [(f"Esophageal {k}", "high" if k == "zz" else "low", k) for k in ("aa", "bb", "cc", "dd", "ee", "zz")])
    assert [g.name for g in got] == ["Esophageal aa", "Esophageal bb", "Esophageal cc", "Esophageal zz"]
    assert got[-1].aliases == ["Esophageal dd", "Esophageal ee"] and got[-1].facts == ["Esophageal zz", "Esophageal dd", "Esophageal ee"]


def test_owned_names_own_none(spark):
    """Against the definition: the owner is the first earlier name without an owner that holds or is held."""
    rng, names = random.Random(3), []
    for _ in range(60):
        names.append("".join(rng.choice("ab") for _ in range(rng.randint(3, 8))))
    df = spark.createDataFrame([(1, k, n, "c") for k, n in enumerate(names)], "pdf_id long, pos long, name string, category string")
    want = {}
    for j, n in enumerate(names):
        want[j] = next((i for i in range(j) if want[i] == i and min(len(n), len(names[i])) >= 4 and (n in names[i] or names[i] in n)), j)
    assert {r.pos: r.owner for r in concepts.owners(df).collect()} == want
