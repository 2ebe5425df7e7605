"""Owners, shares and decks on small tables with several rows of one key, against a plain reading."""

from collections import defaultdict

import pytest

from studymill.operators import access
from studymill.plans import indexed
from studymill.plans.more import FIXTURES as MORE_FIXTURES
from studymill.plans.more import SQL as MORE
from studymill.plans.plan import Plan

PDFS = "user_id long, id long, deck_id string, question_count long, page_count long"
BANKS = "id long, is_active boolean, source_pdf_id long, source_deck_id string"


@pytest.fixture(scope="module")
def tables(spark):
    up = {"r": None, "a": "r", "b": "r", "aa": "a"}
    closure = [(d, x, k) for d in up for k, x in enumerate([d] + [p for p in (up[d], up[up[d]] if up[d] else None) if p])]
    pdfs = [(i // 7, i, [None, "a", "aa", "b", "gone"][i % 5], i % 9 or None, i) for i in range(1, 60)] + [(50, 11, "aa", 4, 4), (51, 12, "b", 5, 5)]
    banks = [(i, i % 5 != 0, i * 2 if i % 3 == 0 else None, ["a", "r", "b"][i % 3] if i % 3 else None) for i in range(1, 20)]
    banks += [(20, True, 11, "a"), (21, True, None, "a"), (21, True, None, "r"), (22, True, 900, None), (23, None, None, "a"), (24, True, None, None)]
    members = [(u, b) for u in [*range(0, 12), 50, None] for b in range(1, 26) if ((u or 3) * 7 + b) % 4 == 0]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (pdfs, banks, members, closure), (frame(pdfs, PDFS), frame(banks, BANKS), frame(members, "user_id long, shared_bank_id long"), frame(closure, "id string, ancestor string, depth long"))


def kinds(pdfs, banks, members, closure):
    out = defaultdict(set)
    for user, i, *_ in pdfs:
        out[user, i].add(access.OWNED)
    for user, bank in members:
        for b, active, pdf, deck in banks:
            if b == bank and active:
                if pdf is not None:
                    out[user, pdf].add(access.PDF_SHARE)
                for d, ancestor, _ in closure:
                    for _, i, of, *_ in pdfs:
                        if ancestor == deck and of == d:
                            out[user, i].add(access.DECK_SHARE)
    return {k: min(v) for k, v in out.items()}


@pytest.mark.parametrize("pack, most", [(512, 4096), (2, 4096), (2, 0)])
def test_pairs_once_with_least_kind(tables, monkeypatch, pack, most):
    monkeypatch.setattr(access, "PACK", pack)
    monkeypatch.setattr(access, "BROADCAST_PACKS", most)
    a = access.Access(*tables[1])
    got = [tuple(r) for r in a.few.select("user_id", "id", "kind").collect()] + [(*r, access.DECK_SHARE) for r in a.further().select("user_id", "id").collect()]
    want = kinds(*tables[0])
    assert len(got) == len(want) and {(u, i): k for u, i, k in got} == want


def test_previews_of_banks_with_several_sources(tables):
    pdfs, banks, members, closure = tables[0]
    want = {}
    for b in {x[0] for x in banks}:
        own = [x for x in banks if x[0] == b]
        seen = {x[2] for x in own} | {i for x in own for d, ancestor, _ in closure if ancestor == x[3] for _, i, of, *_ in pdfs if of == d}
        met = [p for p in pdfs if p[1] in seen]
        want[b] = (*(len(own) * n for n in (sum(p[3] or 0 for p in met), sum(p[4] for p in met), len(met))), sum(m[1] == b for m in members))
    assert {r[0]: tuple(r)[1:] for r in access.previews(*tables[1]).select("id", "questions", "pages", "sources", "members").collect()} == want


def above_explode(plan: str) -> list[str]:
    """The nodes above the first explode of a plan's text."""
    depth, line = lambda x: len(x) - len(x.lstrip(" :+-")), None
    lines = plan.splitlines()
    at = next(k for k, x in enumerate(lines) if "Generate explode" in x)
    out, line = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < line:
            out.append(x)
            line = depth(x)
    return out


@pytest.mark.parametrize("query", [indexed.seen_kinds, indexed.grants, indexed.owned_shared, indexed.scopes])
def test_pairs_of_decks_are_not_shuffled(spark, query):
    """The expanded rows come last: no exchange, sort, join or aggregate stands above their explode."""
    above = above_explode(query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString())
    assert above and not any(x in y for y in above for x in ("Join", "Aggregate", "Repartition", "Sort", "Distinct"))


def test_overlap_joins_no_words(spark):
    plan = indexed.option_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_overlap_of_rows_with_one_id(spark, tmp_path):
    """Rows of one id count together, as their words meet by id: shared words once, over the least of the rows that share any."""
    rows = [(1, "old pin", "SMALL", "B"), (1, "pin", "LARGE", "C"), (2, None, "SMALL", "B"), (3, "x", "y", "z"), (None, "old", "a", "b")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = Plan(MORE["str31_overlap"], MORE_FIXTURES)(spark, str(tmp_path)).collect()
    got = indexed.option_overlap(spark, str(tmp_path)).collect()
    assert len(want) == 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))
