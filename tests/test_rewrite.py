"""Definition-style rewrite against a plain reading of the rule, over all drafts."""

import re

from studymill.functions import rewrite as R
from studymill.functions.validation import OPTION_NOISE
from studymill.plans import indexed

SF = "/root/testdata/sf0.001"


def plain(t):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", re.sub(r"^[a-e][.)]\s*", "", t.lower()))).strip()


def similar(a, b):
    x, y = plain(a), plain(b)
    if not x or not y:
        return False
    if x in y or y in x:
        return True
    p, q = ([w for w in t.split(" ") if len(w) >= 3 and w not in OPTION_NOISE] for t in (x, y))
    return bool(p and q) and sum(w in q for w in p) / min(len(p), len(q)) > 0.65


def score(c, name):
    n = lambda t: len([w for w in plain(t).split(" ") if len(w) >= 3])
    return 10 - min(abs(n(c) - n(name)), 6) - 3 * (bool(re.search(r"\([^)]+\)", c)) != bool(re.search(r"\([^)]+\)", name))) - 2 * (("/" in c) != ("/" in name))


def expected(d, siblings):
    soup = sum(len(o.split()) >= 6 and re.match(R.DEFINITION_OPTION, o.strip()) is not None for o in d.options)
    if d.level != 1 or d.domain not in R.DOMAINS or len(d.options) < 4 or soup < max(3, len(d.options) - 1):
        return None
    near = [s for s in siblings if s.id != d.id and (s.domain == d.domain or re.search(R.RELATED_NAMES, s.name))]
    order = {"high": 0, "medium": 1}
    texts = [*d.candidates, *(s.name for s in sorted(near, key=lambda s: order.get(s.importance, 2)))]
    pool, seen = [], {plain(d.name)}
    for t in map(str.strip, texts):
        if t and plain(t) and plain(t) not in seen:
            seen.add(plain(t))
            pool.append(t)
    if len(pool) < 4:
        return None
    own = (d.distractor or "").strip()
    every = []
    for t in ([own] if own and not re.match(R.DEFINITION_DISTRACTOR, own) else []) + pool:
        if plain(t) != plain(d.name) and plain(t) not in map(plain, every):
            every.append(t)
    if len(every) < 4:
        return None
    ranked = sorted(every, key=lambda t: -score(t, d.name))
    got = []
    for t in ranked:
        if len(got) < 4 and not any(similar(g, t) for g in got):
            got.append(t)
    for t in ranked:
        if len(got) < 4 and plain(t) not in map(plain, got):
            got.append(t)
    at = d.answer if 0 <= d.answer < 5 else 2
    options = got[:at] + [d.name] + got[at:]
    clue = (d.clue or "").strip()
    said = re.sub(r"\.$", "", clue or (d.quote or "").strip() or d.name).strip()
    stem = R.STEM[0] + (said if len(said) <= 140 else said[:137] + "...") + R.STEM[1] if said else R.NO_CLUE
    why = (d.tempting or "").strip() or got[0] + R.NEARBY
    fails = (d.fails or "").strip() or (got[0] + R.FAILS + clue + "." if clue else got[0] + R.FAILS_STEM)
    text = d.name + R.EXPLAINED[0] + got[0] + R.EXPLAINED[1] + re.sub(r"\.$", "", why) + R.EXPLAINED[2] + re.sub(r"\.$", "", fails) + "."
    return (d.id, stem, " ~ ".join(options), at, got[0], why, fails, text)


def test_rewritten_drafts_equal_the_rule(spark):
    drafts = indexed.table("definition_drafts")(spark, SF).orderBy("id").collect()
    want = [x for d in drafts if (x := expected(d, [s for s in drafts if s.book == d.book]))]
    got = sorted(tuple(r) for r in indexed.rewritten_drafts(spark, SF).collect())
    assert got == want and 30 < len(want) < len(drafts)


def test_places_tell_where_nothing_else_does(spark):
    def norm(t):
        return re.sub(r"([.,;:!?])[.,;:!?]+", r"\1", re.sub(r"\s+", " ", t)).lower().strip()

    rows = {r.id: r for r in indexed.table("placed_quotes")(spark, SF).collect()}
    kinds = {}
    for r in indexed.placed_evidence(spark, SF).collect():
        d = rows[r.id]
        kinds[r.type, r.confidence] = kinds.get((r.type, r.confidence), 0) + 1
        if d.quote is None or len(d.quote) < 15:
            want = ("none", 0.0)
        elif d.quote in d.source:
            want = ("exact", 1.0)
        elif norm(d.quote) in norm(d.source):
            want = ("normalized", 0.9)
        elif d.a is not None and d.b > d.a and norm(d.source[d.a : d.b]) == norm(d.quote):
            want = ("normalized", 0.85)
        else:
            continue  # clauses and fuzzy windows have tests of their own
        assert (r.type, r.confidence) == want, d
    assert kinds[("normalized", 0.85)] > 10 and kinds[("exact", 1.0)] > 10
