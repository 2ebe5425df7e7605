"""The index of held strings against all pairs."""

import random

import pytest

from studymill.operators import matching


def rows(rng, n, lo, hi):
    return ["".join(rng.choice("abc é漢\n") for _ in range(rng.randint(lo, hi))) for _ in range(n)]


@pytest.mark.parametrize("by", [None, "kind"])
def test_equals_all_pairs(spark, by):
    rng = random.Random(6)
    texts = rows(rng, 40, 0, 300) + rows(rng, 20, 0, 6) + [None, ""]
    needles = [t[a : a + rng.randint(1, 60)] for t in texts if t for a in [rng.randrange(len(t))]] + rows(rng, 30, 1, 40) + [None, "", "zz", texts[0], texts[0]]
    kind = lambda k: ["x", "y", None][k % 3]
    n = spark.createDataFrame([(k, x, kind(k)) for k, x in enumerate(needles)], "needle_id long, needle string, kind string").repartition(3)
    t = spark.createDataFrame([(k, x, kind(k)) for k, x in enumerate(texts)], "text_id long, text string, kind string").repartition(3)
    got = sorted(tuple(r) for r in matching.contained(n, t, by=by).collect())
    want = sorted((i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if x and y is not None and x in y and (not by or kind(i) == kind(j)))
    assert got == want and len(got) > 100
    assert matching.contained(n.where("false"), t).count() == 0 and matching.contained(n, t.where("false")).count() == 0
