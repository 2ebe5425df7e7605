"""Ranks, quantiles and closures against plain readings."""

import random
import statistics

from pyspark.sql import functions as F

from studymill.operators import hierarchy, ranking


def test_ranks_within_groups_and_over_the_table(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 20 + ["cold", None]), rng.randint(0, 30), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    for groups in ((), ("g",)):
        got = ranking.ranked(df, [F.desc("v"), F.asc("id")], groups, "place", "size").collect()
        want = {}
        for r in sorted(rows, key=lambda r: (-r[1], r[2])):
            own = want.setdefault(r[0] if groups else 0, [])
            own.append(r[2])
        assert len(got) == len(rows)
        for r in got:
            own = want[r.g if groups else 0]
            assert own[r["place"] - 1] == r.id and r["size"] == len(own)
    assert ranking.ranked(df.where("false"), [F.asc("id")]).count() == 0


def test_a_large_offset_table_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ranking.checked, "__defaults__", (3,))
    df = spark.range(500).select((F.col("id") % 40).alias("g"), "id")
    got = ranking.ranked(df, [F.desc("id")], ("g",)).collect()
    assert all(r["place"] == sum(x % 40 == r.g and x >= r.id for x in range(500)) for r in got)


def test_medians_are_exact(spark):
    rng = random.Random(2)
    groups = {"a": [rng.choice([rng.uniform(-1e9, 1e9), rng.uniform(0, 1e-9), 7.0]) for _ in range(2001)], "b": [5.0] * 10, "c": [1.0, 2.0], "d": [-1e308, 1e308, 1e308], "e": [3.0], None: [rng.gauss(0, 1) for _ in range(500)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("e", None), ("f", None), ("e", float("nan")), ("e", float("inf"))]
    got = {r[0]: r[1] for r in ranking.medians(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v").collect()}
    for g, vs in groups.items():
        assert got.get(g) == statistics.median(vs) or g is None
    assert "f" not in got
    wanted = spark.createDataFrame([("a", k) for k in (1, 2, 1000, 2001, 2002, 0)], "g string, rank long")
    at = {r["rank"]: r["v"] for r in ranking.values_at(spark.createDataFrame(rows, "g string, v double"), wanted, "g", "v", buckets=4).collect()}
    assert at == {k: sorted(groups["a"])[k - 1] for k in (1, 2, 1000, 2001)}


def plain_closure(parent):
    out = set()
    for x in parent:
        seen, at, depth = set(), x, 0
        while at is not None and at not in seen:
            seen.add(at)
            out.add((x, at, depth))
            at, depth = parent.get(at), depth + 1
    return out


def test_closure_of_a_long_path_a_tree_and_cycles(spark):
    rng = random.Random(3)
    parent = {f"p{k}": f"p{k - 1}" if k else None for k in range(500)}  # beyond the engine's 100 levels of recursion
    parent |= {f"t{k}": f"t{rng.randrange(k)}" if k else None for k in range(300)}
    parent |= {f"c{k}": f"c{(k + 1) % 7}" for k in range(7)} | {"into": "c3", "self": "self", "lost": "nowhere"}
    df = spark.createDataFrame(list(parent.items()), "id string, parent_id string")
    pairs = hierarchy.closure(df)
    assert {tuple(r) for r in pairs.collect()} == plain_closure(parent)
    nodes = df.select("*", F.lit(3).alias("position"), F.col("id").alias("name"))
    got = dict(map(tuple, hierarchy.paths(pairs, nodes).collect()))
    assert got["p2"] == "1000003p0/1000003p1/1000003p2" and not {"c1", "into", "self", "lost"} & set(got)
    assert hierarchy.closure(df.where("false")).count() == 0
