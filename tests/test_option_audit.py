"""Option audits against a plain reading of the rules: ARR03, AGG19."""

import math
import re
from collections import Counter

from studymill.functions import text as T
from studymill.plans import content, rules

SF = "/root/testdata/sf0.001"


def words(o):
    return re.split(r"[ \t\n\r\f\v ]+", o.strip(" \t\n\r\f\v "))


def flags(options, answer):
    n, out = len(options), []
    has = lambda ws: sum(re.search(rf"\b({'|'.join(ws)})\b", o, re.I | re.A) is not None for o in options)
    size = [len(words(o)) for o in options]
    key = options[answer] if 0 <= answer < n else ""
    if any(re.search("all of the above|none of the above", o, re.I) for o in options):
        out.append("NONE_ALL_OF_ABOVE")
    if has(T.ACTIONS) >= 2 and has(T.DIAGNOSES) >= 2:
        out.append("MIXED_CATEGORY")
    if n >= 3 and max(size) > 2.5 * min(size):
        out.append("LENGTH_OUTLIER")
    bracket = [o for o in options if re.search(r"\([^)]+\)", o)]
    if len(bracket) == 1 and re.search(r"\([^)]+\)", key):
        out.append("UNIQUE_QUALIFIER")
    long = [set(w for w in re.split(r"[ \t\n\r\f\v ]+", o.lower()) if len(w) > 3) for o in options]
    for i in range(n):
        for j in range(i + 1, n):
            both = len(long[i] & long[j])
            if both and both / max(1, min(len(long[i]), len(long[j]))) > 0.65:
                out.append(f"OPTION_OVERLAP_{i}_{j}")
    others = [s for i, s in enumerate(size) if i != answer]
    mean, own = sum(others) / len(others) if others else 0, len(words(key))
    if own > 1.3 * mean and own - mean > 4:
        out.append("CORRECT_LONGER_TELL")
    last = [words(o)[-1].lower() for o in options]
    if n >= 3 and len(last[0]) >= 4 and len(set(last)) == 1:
        out.append("SHARED_SUFFIX")
    ends = lambda ws: sum(len(words(o)) >= 3 and words(o.lower())[-1] in ws for o in options) >= math.ceil(0.6 * n)
    if n >= 3 and ends(T.DESCRIPTORS):
        out.append("DESCRIPTOR_SUFFIX")
    if n >= 3 and ends(T.BROAD_LABELS):
        out.append("GENERIC_LABEL_SUFFIX")
    if has(T.ANATOMY) >= 2 and has(T.MECHANISMS) >= 2:
        out.append("ANATOMY_MECHANISM_MIX")
    return out


def test_flags_of_all_option_sets(spark):
    drafts = rules.table("drafts")(spark, SF).select("id", "options", "answer", T.option_flags(rules.C("options"), rules.C("answer")).alias("flags")).collect()
    want = Counter()
    for d in drafts:
        expected = flags(d.options, d.answer)
        assert sorted(d.flags) == sorted(expected), d
        want.update(expected)
    assert dict(map(tuple, rules.QUERIES["agg19_flag_frequency"](spark, SF).collect())) == dict(want)
    assert len({f.split("_OVERLAP")[0] for f in want}) >= 7


def test_flags_of_all_parts(spark):
    parts = {p.p_partkey: p for p in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in content.option_audit(spark, SF).collect():
        p = parts[r.p_partkey]
        options = [f"{p.p_name} level", f"{p.p_type} ion level", f"{p.p_brand} (x) rate value", p.p_name]
        assert sorted(filter(None, r.flags.split(","))) == sorted(flags(options, r.p_partkey % 4))


def test_fact_checks_of_all_drafts(spark):
    drafts = {d.id: d for d in rules.table("drafts")(spark, SF).collect()}
    got = rules.QUERIES["fil20_fact_check"](spark, SF).collect()
    assert len(got) == len(drafts)
    for r in got:
        d = drafts[r.id]
        chunk = "chunk" if r.id % 3 == 0 else ""
        assert r.accurate == (r.id % 4 != 0 and not flags(d.options, d.answer))
        assert r.sourced == (((d.quote or "") + " " + chunk).strip(" ") != "" and d.quote != "UNGROUNDED")
    assert len({(r.accurate, r.sourced) for r in got}) >= 3
