"""Near duplicates and repeated spans against brute force."""

import random
import re

import numpy as np

import pytest

from studymill.llm import near_dedup, substring_dedup
from studymill.llm.components import components

from .conftest import sentence


def sets_of(texts, width):
    out = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute(texts, width=4, percent=80):
    sets = sets_of(texts, width)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs, empty, rows):
    want = brute([(i, t) for i, t, _ in rows])
    got = near_dedup.near_duplicates(docs, width=4).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_chains_and_large_buckets(spark):
    """Near copies whose ends aren't linked themselves, a passage that many share, and sets about the limit of the sketches."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts, base = [], [word() for _ in range(120)]
    for k in range(12):  # a chain
        base = list(base)
        base[10 * (k % 12) + 5] = word()
        texts.append(" ".join(base))
    passage = [word() for _ in range(60)]
    for k in range(60):  # far from each other, but with a common passage
        texts.append(" ".join(passage + [word() for _ in range(60)]))
    long = [word() for _ in range(3000)]
    for k in range(6):
        n = 2700 + 150 * k
        texts.append(" ".join(long[:n]))
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    want = brute(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=4).collect()} == want
    assert want[11][1] == 0


def test_large_buckets_are_searched_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "CELL", 4)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shared = [word() for _ in range(100)]
    pairs = []
    for k in range(20):  # pairs of near copies, each pair over one long common passage
        own = [word() for _ in range(45)]
        pairs += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + own[:-1] + [word()]))]
    for k in range(60):  # near copies of one text, about the threshold
        copy = list(shared)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(100)] = word()
        pairs.append((100 + k, " ".join(copy[: rng.choice([100, 100, 96])])))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=4).collect()} == brute(pairs)


def test_crowded_pairs_hold_every_link(spark, monkeypatch):
    """The exact search finds each pair of sets at the threshold, without the sketches."""
    monkeypatch.setattr(near_dedup, "CELL", 8)
    rng = random.Random(6)
    sets = []
    for k in range(150):
        base = random.Random(k % 5).sample(range(10**6), 60)
        sets.append(sorted({x if rng.random() > 0.04 * (k % 4) else rng.randrange(10**6) for x in base[: rng.randint(48, 60)]}))
    df = spark.createDataFrame([(k, k, x) for k, x in enumerate(sets)], "doc_id long, component long, shingles array<long>").repartition(3)
    got = {(r.a, r.b) for r in near_dedup.crowded_pairs(df, 80).collect()}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert want and want <= got and len(got) < 150 * 149 / 4


def test_repeated_rows_and_texts_of_one_id(spark):
    """A repeated row adds no rows to the pairs; texts of one id are one document, linked by any of them."""
    rng = random.Random(8)
    text = [sentence(rng) for _ in range(12)]
    near, other = " ".join(text[:11]), " ".join(sentence(rng) for _ in range(9))
    rows = [(1, " ".join(text))] * 200 + [(2, near)] * 200 + [(2, other), (7, other), (9, "alone among them all")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 7: 1, 9: 9}
    sets = near_dedup.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,), (2,)], "id long"), 4)
    assert sorted(r.doc_id for r in sets.where("doc_id <= 2").collect()) == [1, 2, 2]


def test_small_partitions_share_tasks(spark):
    """With many shuffle partitions, the rounds of a few edges start few tasks."""
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "")
        found = components(spark.createDataFrame([(1, k) for k in range(2, 50)] + [(50, 51), (51, 52)], "a long, b long")).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.component for r in found} == {k: 1 if k < 50 else 50 for k in range(1, 53)}
    track = sc.statusTracker()
    stages = {i for job in track.getJobIdsForGroup("few-tasks") for i in track.getJobInfo(job).stageIds}
    tasks = sum(x.numCompletedTasks for i in stages if (x := track.getStageInfo(i)))
    assert 0 < tasks < 120, tasks


def test_estimates_are_near():
    rng = np.random.default_rng(1)
    for n in (50, 500, 20_000):
        common, a, b = (rng.integers(0, 2**64, k, np.uint64) for k in (n, n // 8, n // 8))
        x, y = np.r_[common, a], np.r_[common, b]
        make = near_dedup.small_sketch if n < near_dedup.FILL * near_dedup.M else near_dedup.large_sketch
        share = 1.0 if n < near_dedup.FILL * near_dedup.M else 1 / near_dedup.M
        equal = sum(p == q for p, q in zip(np.frombuffer(make(x), np.uint16), np.frombuffer(make(y), np.uint16)))
        e = near_dedup.estimates(np.array([equal]), np.array([len(x) * share]), np.array([len(y) * share]))[0]
        assert abs(e - 0.8) < 0.15


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 103), (103, 101)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in (100, 101, 103)}


def windows(text, n=50):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_passages_over_50_words_stay_once(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))

    def prose(n):
        out = []
        while len(out) < n:
            s = [word() for _ in range(rng.randint(3, 15))]
            s[0], s[-1] = s[0].capitalize(), s[-1] + "."
            out += s
        return out[:n]

    passages = [prose(60), prose(52), [word() for _ in range(70)], prose(90)]
    texts, clean = [], []
    for k in range(48):
        w = prose(rng.randint(20, 200))
        if k % 2:
            at = rng.randint(0, len(w))
            w[at:at] = passages[k // 2 % 4]
        else:
            clean.append(k)
        texts.append((k, " ".join(w)))
    got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), least=substring_dedup.LEAST).collect()}
    seen = {}
    for k, t in sorted(got.items()):
        for g in windows(t):
            assert seen.setdefault(g, k) == k
    for k in clean:
        assert got[k] == texts[k][1]
    for p in passages:  # and none is lost
        assert any(" ".join(p)[-60:] in t for t in got.values())


def test_spans_bear_the_edges(docs, empty):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert len(got) == docs.count() and substring_dedup.dedup_substrings(empty).count() == 0
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for r in got:
        assert (r.n_tokens, r.band, r.rank) == (7, "b", 0.5)
        if r.n_removed_words == 0:
            assert (r.doc_id, r.text) in texts


@pytest.mark.parametrize("least", [0, substring_dedup.LEAST])
def test_removed_sentences_equal_brute_force(spark, least):
    """Runs as tuples of words, compared with all runs of all documents before."""
    rng = random.Random(12)
    pool = [sentence(rng, rng.randint(2, 14)) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for k in range(60)]
    cut, runs, want = substring_dedup.Sentences(), {}, {}
    for k, t in rows:
        w, at = t.split(), cut(t)[1].tolist()
        ends = [*at[1:], len(w)]
        for i in range(len(at)):
            j = next((j for j in range(i + 1, len(at)) if ends[j] >= at[i] + least), None)
            if j is not None:
                runs.setdefault(tuple(w[at[i] : ends[j]]), []).append((k, i, j))
    for k, t in rows:
        w, at = t.split(), cut(t)[1].tolist()
        gone = {x for found in runs.values() for n, (d, i, j) in enumerate(found) if d == k and n for x in range(i, j + 1)}
        want[k] = [x for s, (a, b) in enumerate(zip(at, [*at[1:], len(w)])) if s not in gone for x in w[a:b]]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least=least).collect()}
    assert {k: r.text.split() for k, r in got.items()} == want and sum(r.n_removed_words for r in got.values()) > 50


def test_a_run_needs_both_hashes(spark, monkeypatch):
    """Equal first hashes alone remove nothing."""
    spans = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (6, 3, 1), (6, 3, 4)], "span long, second int, doc_id long")
    monkeypatch.setattr(substring_dedup, "span_rows", lambda docs, least: spans)
    assert {(r.gone_id, tuple(r.spans)) for r in substring_dedup.repeated_spans(None).collect()} == {(4, (6,))}


def test_short_runs_go_unless_a_length_is_asked(spark):
    lines = ["Foo bar baz qux. All rights reserved here."] * 6
    rows = [(k, f"{w} alone stands first. {t}") for k, (w, t) in enumerate(zip("abcdef", lines))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed_words for r in substring_dedup.dedup_substrings(df).orderBy("doc_id").collect()] == [0, 8, 8, 8, 8, 8]
    assert not any(r.n_removed_words for r in substring_dedup.dedup_substrings(df, least=20).collect())
