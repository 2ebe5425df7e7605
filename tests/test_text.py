"""Literal cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from studymill.functions import text as T

L = F.lit
A = lambda *xs: F.array(*map(F.lit, xs))
STEM = "A 60-year-old man has a lesion with the following changes that appear in the intima of the aorta and other large vessels over many years; which of the following best explains the appearance of obliterative changes?"
SOURCE = STEM.replace("appearance", "appear - ance").replace("obliterative", "oblitera - tive")

CASES = {
    "plain": (lambda: T.plain(L("  It’s “Fine” – ok\n x ")), "it s fine ok x"),
    "label": (lambda: T.label(L("A--b  C!")), "a b c"),
    "evidence_text": (lambda: T.evidence_text(L("“Hi” it’s—so,, ok!?  Yes")), "\"hi\" it's-so, ok! yes"),
    "search_text": (lambda: T.search_text(L(" A—b,,  C ")), "a-b,, c"),
    "copy_text": (lambda: T.copy_text(L("appear - ance—x")), "appearance x"),
    "without_label": (lambda: T.without_label(L(" B) Renin ")), "Renin"),
    "singular": (lambda: T.singular_text(L("bodies losses cats glass bus")), "body loss cat glass bus"),
    "aliases": (lambda: T.option_aliases(L("A. Antidiuretic Hormones (ADH)")), ["antidiuretic hormones adh", "antidiuretic hormones", "adh", "antidiuretic hormone adh", "antidiuretic hormone"]),
    "mentions": (lambda: T.mentions(L("the adh level"), L("adh")), True),
    "mentions_not": (lambda: T.mentions(L("the adhesion"), L("adh")), False),
    "fingerprint": (lambda: T.fingerprint(L("Which of the following veins store the blood?")), "veins store blood"),
    "fingerprint_stop_words": (lambda: T.fingerprint(L("Which of the following is this?")), ""),
    "merge_key": (lambda: T.merge_key(L("Left-Ventricle"), L("Cardiac X1")), "leftventricle|cardiacx"),
    "slug": (lambda: T.slug(L("  --Hello World!! ")), "hello-world"),
    "slug_empty": (lambda: T.slug(L("!!")), "bank"),
    "declarative": (lambda: T.is_interrogative(L("A statement.")), False),
    "question": (lambda: T.is_interrogative(L("Is it?")), True),
    "cited_question": (lambda: T.is_interrogative(L("x? (Chapter 25)")), True),
    "which": (lambda: T.is_interrogative(L("Blood flows. Which of the following is a secretion")), True),
    "negation": (lambda: T.is_negation(L("All are true EXCEPT one")), True),
    "no_negation": (lambda: T.is_negation(L("A notable thing")), False),
    "case": (lambda: T.opens_with_case(L("A 45-year-old male presents with")), True),
    "quote_fragment": (lambda: T.quote_fault(L("- ing of the bladder")), "fragment"),
    "quote_lower": (lambda: T.quote_fault(L("lower start of a sentence with ten words or more here.")), "fragment"),
    "quote_long": (lambda: T.quote_fault(L(" ".join(["Word"] * 36))), "too long"),
    "quote_fine": (lambda: T.quote_fault(L("The heart pumps blood through the body and the lungs every day.")), None),
    "quote_two": (lambda: T.quote_fault(L("The heart pumps blood through it. The lungs breathe air every day.")), "several sentences"),
    "mcq": (lambda: T.is_embedded_mcq(L("A Endothelial cell disruption B Intimal thickening")), True),
    "domain": (lambda: T.coverage_domain(L("Venous compliance"), L("x")), "pressure_volume_quantitative"),
    "domain_first": (lambda: T.coverage_domain(L("Pressure regulation"), L("Drug")), "mechanism_causal"),
    "domain_none": (lambda: T.coverage_domain(L(None).cast("string"), L("x")), "entity_recall"),
    "similar": (lambda: T.option_similarity(L("A. Vascular compliance"), L("Compliance")), 1.0),
    "clauses": (lambda: T.clause_match(L("Critical for maintaining blood pressure during stress or blood loss; elicits nerve signals to constrict veins."), L("It is critical for maintaining blood pressure during stress or blood loss. It elicits nerve signals to constrict veins.")), 0.9),
    "length_fault": (lambda: T.length_fault(A("A", "B", "C", "This is a much longer correct answer"), L(3)), True),
    "length_fine": (lambda: T.length_fault(A("abcd", "efgh", "ijkl", "mnop"), L(0)), False),
    "flags": (lambda: T.option_flags(A("Sodium ion level", "Potassium ion level", "Calcium ion level", "Chloride (x) ion level"), L(3)), ["UNIQUE_QUALIFIER", "SHARED_SUFFIX", "DESCRIPTOR_SUFFIX"]),
    "flags_mix": (lambda: T.option_flags(A("the renal vein", "Renal artery filtration", "glomerulus secretion", "All of the above"), L(0)), ["NONE_ALL_OF_ABOVE", "ANATOMY_MECHANISM_MIX"]),
    "flags_overlap": (lambda: T.option_flags(A("cardiac output rises", "cardiac output falls", "other option"), L(2)), ["OPTION_OVERLAP_0_1"]),
    "answer_letter": (lambda: T.answer_index(L(" b ")), 1),
    "answer_number": (lambda: T.answer_index(L("3")), 3),
    "answer_other": (lambda: T.answer_index(L("x")), 0),
    "level": (lambda: T.question_level(L("L2")), 2),
    "anchor": (lambda: T.anchor_support(L("CHF causes RV strain"), L("RV strain can develop in CHF")), True),
    "no_anchor": (lambda: T.anchor_support(L("venous constriction raises return"), L("the liver stores glycogen")), False),
    "fuzzy": (lambda: F.round(T.fuzzy_ratio(L("cardiac output depends on heart rate and stroke volume"), L("Cardiac output primarily depends on heart rate and stroke volume during exercise.")), 3) >= 0.6, True),
    "no_fuzzy": (lambda: T.fuzzy_ratio(L("cardiac output depends on heart rate"), L("The liver stores glycogen and iron for the body every day")), 0.0),
    "verdict_evidence": (lambda: T.verdict(A("Length fine", "Source quote missing")), "EVIDENCE_GROUNDING"),
    "verdict_options": (lambda: T.verdict(A("Options are overly overlapping")), "OPTION_SET_HOMOGENEITY"),
    "verdict_pedagogy": (lambda: T.verdict(A("whyTempting missing", "Explanation is too short")), "CLINICAL_PEDAGOGY"),
    "verdict_reject": (lambda: T.verdict(A("something else")), "DETERMINISTIC_VALIDATION"),
    "key_matches": (lambda: T.key_mismatch(A("Aldosterone", "ADH", "ANP", "Renin"), L(1), L("ADH is correct because it raises water reabsorption.")), None),
    "key_differs": (lambda: T.key_mismatch(A("Aldosterone", "ADH", "ANP", "Renin"), L(1), L("Aldosterone is correct because it raises sodium reabsorption.")), "Aldosterone"),
    "copied": (lambda: T.is_copied_stem(L(STEM), L(f"xx {SOURCE} yy")), True),
    "not_copied": (lambda: T.is_copied_stem(L(STEM), L("nothing of it")), False),
}


def test_literal_cases(spark):
    row = spark.range(1).select(*(make().alias(name) for name, (make, _) in CASES.items())).first()
    assert {n: row[n] for n in CASES} == {n: want for n, (_, want) in CASES.items()}


@pytest.mark.parametrize("quote,source,kind", [
    ("Cardiac output depends on rate.", "So: Cardiac output depends on rate.", "exact"),
    ("Cardiac output depends on rate.", "x cardiac  output depends on rate. y", "normalized"),
    ("cardiac output depends on heart rate and stroke volume", "Cardiac output primarily depends on heart rate and stroke volume during exercise.", "fuzzy"),
    ("UNGROUNDED", "anything", "none"),
    ("Cardiac output depends on rate.", None, "none"),
    ("Too short", "Too short", "none"),
])
def test_evidence(spark, quote, source, kind):
    assert spark.range(1).select(T.evidence(L(quote), L(source).cast("string")).type.alias("t")).first().t == kind


def test_cosine(spark):
    v = lambda *xs: F.array(*map(F.lit, xs))
    row = spark.range(1).select(T.cosine(v(1.0, 0.0), v(0.98, 0.02)).alias("a"), T.cosine(v(1.0), v(1.0, 2.0)).alias("b"), T.cosine(v(0.0), v(1.0)).alias("c")).first()
    assert abs(row.a - 0.99979) < 1e-4 and (row.b, row.c) == (0.0, 0.0)
