"""Pairs from packs against a plain reading, with several rows of one id, nulls and groups over several packs."""

import pytest
from pyspark.sql import functions as F

from studymill.operators import packs
from studymill.plans import indexed


@pytest.mark.parametrize("size, most", [(512, 4096), (3, 4096), (3, 0)])
def test_pairs_of_packs(spark, monkeypatch, size, most):
    monkeypatch.setattr(packs, "PACK", size)
    monkeypatch.setattr(packs, "BROADCAST_PACKS", most)
    rows = [(f"g{k % 3}", k) for k in range(40)] + [("g1", 7), ("g1", 7), (None, 3), ("g2", None)]
    asks = [("g0", 5), ("g1", 7), ("g1", 30), ("g1", 30), ("gone", 1), (None, 2), ("g2", 2)]
    got = packs.paired(spark.createDataFrame(asks, "g string, i long"), packs.packed(spark.createDataFrame(rows, "g string, id long"), "g", "id"), "g", "j", F.col("i") != F.col("j"))
    want = [(i, j) for g, i in asks for h, j in rows if g is not None and g == h and j is not None and i != j]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("query", [indexed.association_peers, indexed.name_containment])
def test_pairs_are_expanded_last(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert not any(x in above for x in ("Join", "Repartition", "Sort", "Aggregate"))
