"""Canonical concepts of all documents against a plain reading of ALG04."""

import re

from studymill.operators import concepts
from studymill.plans import content

SF = "/root/testdata/sf0.001"
RANK = {"high": 3, "medium": 2, "low": 1}


def canonical(rows):
    """(name, importance, aliases) in order: names that hold each other merge, then each prefix keeps four."""
    rows = [dict(name=r.name, category=r.category or "", importance=r.importance, aliases=[]) for r in sorted(rows, key=lambda r: r.pos)]
    plain = [re.sub("[^a-z0-9]", "", r["name"].lower()) for r in rows]
    used = set()
    for i, a in enumerate(rows):
        if i in used:
            continue
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if j not in used and a["category"] == b["category"] and min(len(plain[i]), len(plain[j])) >= 4 and (plain[i] in plain[j] or plain[j] in plain[i]):
                a["aliases"].append(b["name"])
                if RANK[b["importance"]] > RANK[a["importance"]]:
                    a["importance"] = b["importance"]
                used.add(j)
    rows = [r for k, r in enumerate(rows) if k not in used]
    groups = {}
    for r in rows:
        w = re.sub("[^a-zA-Z0-9 ]", "", r["name"]).split()
        groups.setdefault((w[0] if w and len(w[0]) > 4 else " ".join(w[:2])).lower(), []).append(r)
    dropped = []
    for own in groups.values():
        own.sort(key=lambda r: -RANK[r["importance"]])
        for r in own[4:]:
            own[0]["aliases"] += [r["name"], *r["aliases"]]
            dropped.append(id(r))
    return [(r["name"], r["importance"], "; ".join(r["aliases"])) for r in rows if id(r) not in dropped]


def test_all_documents(spark):
    merged = concepts.merged_inventory(content.raw_concepts(spark, SF)).collect()
    got = content.canonical_concepts(spark, SF).collect()
    assert {r.pdf_id for r in got} == {r.pdf_id for r in merged}
    with_aliases = 0
    for pdf in {r.pdf_id for r in merged}:
        mine = [(r.name, r.importance, r.aliases) for r in sorted((r for r in got if r.pdf_id == pdf), key=lambda r: r.place)]
        want = canonical([r for r in merged if r.pdf_id == pdf])
        assert mine == want
        with_aliases += sum(bool(x[2]) for x in want)
    assert with_aliases > 3
