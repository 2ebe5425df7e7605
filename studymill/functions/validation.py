"""Question validation: issues of a question or draft, their canonical forms, and repairs, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .text import L, R, S, bound, trimmed

# The texts of issues by option flag, and openings of template stems.
FLAG_ISSUES = {
    "NONE_ALL_OF_ABOVE": 'Option set uses "all of the above" or "none of the above," which violates the answer-choice rules.',
    "MIXED_CATEGORY": "Answer choices mix conceptual categories instead of staying in one comparison class.",
    "LENGTH_OUTLIER": "Option lengths create a test-taking tell rather than requiring medical knowledge.",
    "CORRECT_LONGER_TELL": "Option lengths create a test-taking tell rather than requiring medical knowledge.",
    "UNIQUE_QUALIFIER": "The keyed answer stands out with a unique qualifier or parenthetical detail.",
    "SHARED_SUFFIX": "All options end with the same word — remove the artificial suffix so each option reads naturally.",
    "DESCRIPTOR_SUFFIX": "Options contain artificial descriptor suffixes (Level/Rate/Measurement/Evaluation/Value etc.) — use bare concept names or natural phrases without tacked-on descriptor nouns.",
    "GENERIC_LABEL_SUFFIX": "Options are padded with generic labels such as Mechanism/Process/Structure/Regulation/Control — use real named concepts or natural answer phrases instead.",
    "ANATOMY_MECHANISM_MIX": "Options mix anatomical structures with physiological mechanisms/processes — all options must stay in one comparison class.",
}
OVERLAP_ISSUE = "Two answer choices are overly overlapping, which weakens distractor diversity."
TEMPLATE_STEMS = [
    "the concept defined by",
    "the condition defined by",
    "the (renal|glomerular|tubular|interstitial|pathological?) (pathology|condition|disease|process) (best )?characterized by",
    "which (renal|glomerular|tubular|pathological?) (condition|disease|process|pathology) is (best )?characterized by",
    rf"which anatomical structure{R}",
    rf"which physiological mechanism{R}",
    rf"which condition is characterized by{R}",
    rf"which factor is crucial for{R}",
]
QUOTE_ISSUES = {
    "fragment": "Source quote appears to be a mid-sentence fragment — pick a complete sentence that starts with a capital letter.",
    "too short": "Source quote must be at least 10 words copied verbatim from the source passages.",
    "several sentences": "Source quote must be a single sentence from the source passages — do not merge multiple sentences.",
    "no sentence": "Source quote must be a complete sentence ending in a period from the source passages.",
    "contents page": "Source quote appears to be a table of contents or index page — use a verbatim sentence from the body text.",
    "option list": "Source quote appears to be a multiple-choice option list, not prose. Pick a single explanatory sentence from the body text.",
    "question stem": "Source quote must be explanatory prose from the source, not a test question stem.",
}
#: Issues of unique_issues, at most (fixed value).
MOST_ISSUES = 8
# Words that tell no options apart.
OPTION_NOISE = """particles cells cell disease diseases syndrome syndromes disorder disorders condition conditions type types
formation occurrence incident event process mechanism therapy treatment development activation dysfunction injury damage
response reaction changes change""".split()


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)


def canonical_issue(c: Column) -> Column:
    """STR26."""
    t = T.plain(c)
    has = lambda *ws: [F.contains(t, F.lit(w)) for w in ws]
    either = lambda a, b: a | b
    return (
        F.when(has("key distinction")[0] & either(*has("missing", "lacks")), "missing_key_distinction")
        .when(either(*has("contrast", "distractor")) & either(*has("explanation does not", "explanation lacks")), "missing_distractor_contrast")
        .when(has("source quote")[0] & either(*has("could not be verified", "does not provide specific evidence")), "source_quote_not_verified")
        .when(has("correct answer")[0] & either(*has("not clearly supported", "does not support")), "correct_answer_not_supported")
        .when(has("explanation")[0] & either(*has("different answer choice", "keyed correct answer")), "explanation_answer_mismatch")
        .when(has("fabricated distractor")[0], "fabricated_distractor")
        .otherwise(t)
    )


def unique_issues(issues: Column, most: int = MOST_ISSUES) -> Column:
    """STR27: the first issue of each canonical form."""
    pairs = F.transform(issues, lambda i: F.struct(T.squeezed(i).alias("issue"), canonical_issue(i).alias("form")))
    first = bound(F.filter(pairs, lambda p: p["issue"] != ""), lambda ps: F.filter(ps, lambda p, k: F.array_position(F.transform(ps, lambda x: x["form"]), p["form"]) == k + 1))
    return F.slice(F.transform(first, lambda p: p["issue"]), 1, most)


def word_number(c: Column) -> Column:
    return F.size(F.split(trimmed(c), f"{S}+"))


def length_issue(options: Column, answer: Column) -> Column:
    """MTH11 as an issue."""
    key = word_number(F.coalesce(F.get(options, answer), F.lit("")))
    others = F.filter(F.transform(options, lambda o, i: F.when(i != answer, word_number(o))), lambda n: n.isNotNull())
    mean = F.aggregate(others, F.lit(0), lambda s, n: s + n) / F.greatest(F.lit(1), F.size(others))
    ratio = F.when(mean > 0, key / mean).otherwise(1.0)
    text = F.concat(F.lit("Correct answer ("), key.cast("string"), F.lit(" words) is "), one_decimal(ratio), F.lit("x longer than average distractor ("), one_decimal(mean), F.lit(" words). Trim the correct answer or expand distractors so all options are within 2 words of each other in length."))
    return F.when((ratio >= 1.6) & (key - mean >= 2.5) & (key >= 5), text)


def quote_issue(c: Column) -> Column:
    """STR25 as an issue."""
    fault = T.quote_fault(c)
    out = F.when(fault == "too long", F.concat(F.lit("Source quote is too long ("), F.size(T.words(trimmed(c))).cast("string"), F.lit(" words). Pick a single body-text sentence under 35 words that directly proves the keyed answer.")))
    for name, issue in QUOTE_ISSUES.items():
        out = out.when(fault == name, issue)
    return out


def mismatch_issue(options: Column, answer: Column, explanation: Column) -> Column:
    """ALG15 as an issue."""
    issue = lambda other: F.when(other.isNotNull(), F.concat(F.lit("Explanation appears to justify a different answer choice than the keyed correct answer ("), other, F.lit(").")))
    return bound(T.key_mismatch(options, answer, explanation), issue)


def is_template_stem(c: Column) -> Column:
    return trimmed(c).rlike("(?i)^(" + "|".join(TEMPLATE_STEMS) + ")")


def missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def question_issues(level, stem, options, answer, explanation, quote, clue, target, distractor, tempting, fails, source, fuzzy: bool = False) -> Column:
    """ALG12: struct(issues, flags, evidence_ok) of a question; its arguments are columns, source is the text it must be grounded in."""
    flags = T.option_flags(options, answer)
    texts = F.create_map(*[F.lit(x) for kv in FLAG_ISSUES.items() for x in kv])
    of_flags = F.transform(flags, lambda f: F.when(F.startswith(f, F.lit("OPTION_OVERLAP_")), OVERLAP_ISSUE).otherwise(F.element_at(texts, f)))
    wanted = F.when(level == 1, 5).otherwise(4)
    bare = T.without_label(distractor)
    matches = F.exists(F.transform(options, lambda o, i: (i != answer) & (T.without_label(o) == bare)), lambda x: x)
    told, n_told = trimmed(F.coalesce(explanation, F.lit(""))), word_number(F.coalesce(explanation, F.lit("")))
    q = trimmed(F.coalesce(quote, F.lit("")))
    grounded, sourced = (q != "") & (q != "UNGROUNDED"), trimmed(F.coalesce(source, F.lit(""))) != ""
    found = F.coalesce(T.evidence(q, source, fuzzy)["type"], F.lit("none")) != "none"
    said = T.plain(clue)
    loose = ~missing(clue) & grounded & (said != "") & ~F.contains(T.plain(q), said) & (F.size(F.split(said, " ")) >= 3)
    unsupported = loose & ~T.anchor_support(clue, q) & ~T.anchor_support(F.coalesce(F.get(options, answer), F.lit("")), q)
    when = F.when
    before = F.array(length_issue(options, answer))
    rest = F.array(
        when(F.size(options) != wanted, F.concat(F.lit("Level "), level.cast("string"), F.lit(" questions must have exactly "), wanted.cast("string"), F.lit(" answer choices."))),
        when((level == 1) & T.is_negation(stem), "Level 1 questions should avoid negation stems such as NOT/EXCEPT/LEAST."),
        when(is_template_stem(stem), 'Stem uses a low-value template ("Which anatomical structure…", "Which physiological mechanism…", or "Which condition is characterized by…") — rewrite as a clinical, mechanistic, or applied question that can be answered before seeing the options.'),
        when((level == 3) & ~T.opens_with_case(stem), "Level 3 questions must open with an age, sex, and presentation vignette."),
        when(~T.is_interrogative(stem), "Stem is not phrased as a question."),
        when(missing(target), "Question is missing the required decision target metadata."),
        when(missing(clue), "Question is missing the required deciding clue metadata."),
        when(missing(distractor), "Question is missing the required most tempting distractor metadata.").when(~matches, "Most tempting distractor must match one of the incorrect answer choices exactly."),
        when(missing(tempting), "Question is missing the required whyTempting rationale."),
        when(missing(fails), "Question is missing the required whyFails rationale."),
        when(told == "", "Question is missing an explanation.").when(n_told < 12, "Explanation is too short to teach why the correct answer is right and the top distractor is wrong."),
        when((told != "") & told.rlike(rf"(?i){L}key distinction{R}"), 'Explanation must not include the phrase "Key distinction" — embed the teaching point as plain prose in the two required sentences.'),
        mismatch_issue(options, answer, explanation),
        when(~grounded, "Question is missing a grounded source quote from the PDF.").when(~sourced, "Could not load source PDF text needed to verify the evidence for this question.").otherwise(quote_issue(q)),
        when(grounded & sourced & ~found, "Stored source quote could not be verified against the source PDF text."),
        when(unsupported, "Deciding clue is not clearly supported by the quoted PDF evidence."),
    )
    every = F.filter(F.concat(before, of_flags, rest), lambda i: i.isNotNull())
    return F.struct(unique_issues(every).alias("issues"), flags.alias("flags"), (grounded & sourced & found).alias("evidence_ok"))


def draft_faults(level, wanted_level, stem, options, answer, concept, wanted_concept, name, wanted_name) -> Column:
    """ALG13, before the question's own issues: struct(issues, retry, checked) of a draft against its slot; checked: whether question_issues decides the rest."""
    n = F.when(wanted_level == 1, 5).otherwise(4)
    lacks, wrong, beyond = missing(stem) | (F.size(options) == 0) | (answer < 0), F.size(options) != n, answer >= F.size(options)
    issues = F.array(
        F.when(lacks, "Draft is missing the stem, options, or correctAnswer fields."),
        F.when(wrong, F.concat(F.lit("Level "), wanted_level.cast("string"), F.lit(" questions must have exactly "), n.cast("string"), F.lit(" answer choices."))),
        F.when(beyond, "correctAnswer must point to an existing option."),
        F.when(missing(concept), "Draft is missing conceptId for the requested generation slot.").when(concept != wanted_concept, "Draft conceptId does not match the requested generation slot."),
        F.when(~missing(name) & (T.plain(name) != T.plain(wanted_name)), "Draft conceptName does not match the requested generation slot."),
        F.when(level != wanted_level, F.concat(F.lit("Draft level "), level.cast("string"), F.lit(" does not match expected level "), wanted_level.cast("string"), F.lit("."))),
    )
    retry = lacks | wrong | beyond | missing(concept) | (concept != wanted_concept)
    return F.struct(unique_issues(F.filter(issues, lambda i: i.isNotNull())).alias("issues"), F.coalesce(retry, F.lit(True)).alias("retry"), F.coalesce(~retry, F.lit(False)).alias("checked"))


def without_tail(c: Column) -> Column:
    """STR22: without the last sentence, or without a trailing clause if there is but one."""
    t = trimmed(c)
    parts = F.filter(F.split(t, rf"(?<=[.!?]){S}+"), lambda x: x != "")
    cut = F.regexp_replace(t, rf"(?is)(?:{S}*[,;:]{S}*|{S}+-{S}+|{S}+)(?:because|which|allowing|while|since|as|so that){R}.*$", "")
    return F.when(F.size(parts) > 1, trimmed(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))).otherwise(trimmed(F.regexp_replace(cut, r"[\s,;:.-]+$", "")))


def median_of(numbers: Column) -> Column:
    """AGG36 of an array; 0 if it is empty."""
    return bound(F.array_sort(numbers), lambda x: F.when(F.size(x) == 0, 0.0).otherwise((F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2))


def length_tell(options: Column, answer: Column) -> Column:
    """MTH12: whether the key has over 1.4 times the median of all options' words."""
    n = F.transform(options, lambda o: F.size(T.words(o)))
    middle = median_of(n)
    return (middle > 0) & (F.coalesce(F.get(n, answer), F.lit(0)) > middle * 1.4)


def repaired_tell(options: Column, answer: Column) -> Column:
    """MTH12, repair: the key without its tail, if that has words and at most 1.4 times the others' median; null otherwise."""
    key = F.get(options, answer)
    short = without_tail(key)
    others = F.filter(F.transform(options, lambda o, i: F.when(i != answer, F.size(T.words(o)))), lambda n: n.isNotNull())
    middle = median_of(others)
    fits = (short != "") & (short != trimmed(key)) & (middle > 0) & (F.size(T.words(short)) <= middle * 1.4)
    return F.when(length_tell(options, answer) & fits, short)


def is_calculation(options: Column) -> Column:
    return (F.size(options) >= 4) & F.forall(options, lambda o: trimmed(o).rlike(rf"^[+\-]?\d+(\.\d+)?({S}*(mm{S}*Hg|ml/min|L/day|%|mg/dL|mEq/L|mmol/L))?$"))


def flag_reason(stem: Column, options: Column, raw_answer: Column, explanation: Column, quote: Column, source: Column, fuzzy: bool = False) -> Column:
    """ALG26: the first reason to flag a raw question; null if none. raw_answer: as given, before it is put in range."""
    q = F.coalesce(quote, F.lit(""))
    valid = (raw_answer >= 0) & (raw_answer < F.size(options))
    answer = F.when(valid, raw_answer).otherwise(0)
    return (
        F.when(T.is_copied_stem(F.coalesce(stem, F.lit("")), source), "SOURCE_STEM_COPY")
        .when(T.quote_fault(q).isin("option list", "question stem"), "SOURCE_QUOTE_INVALID")
        .when((F.coalesce(T.evidence(q, source, fuzzy)["type"], F.lit("none")) == "none") & ~is_calculation(options), "QUOTE_NOT_FOUND")
        .when(T.key_mismatch(options, answer, F.coalesce(explanation, F.lit(""))).isNotNull(), "ANSWER_KEY_MISMATCH")
        .when(~valid | (F.size(options) == 0), "INVALID_ANSWER")
    )


def concept_aliases(name: Column, facts: Column) -> Column:
    """STR13: the plain name, facts and bracketed texts, the name's last word from four letters on, and the singular of each; two letters at least."""
    every = F.concat(F.array(name), facts)
    whole = F.transform(every, T.plain)
    tail = bound(F.split(T.plain(name), " "), lambda w: F.when((F.size(w) > 1) & (F.length(F.element_at(w, -1)) >= 4), F.array(F.element_at(w, -1))).otherwise(F.array().cast("array<string>")))
    inner = F.flatten(F.transform(every, lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"\(([^)]+)\)"), 1), T.plain)))
    base = F.concat(whole, tail, inner)
    return F.filter(F.array_distinct(F.concat(base, F.transform(base, T.singular_text))), lambda a: F.length(a) >= 2)


def concept_mismatch(stem: Column, keyed: Column, name: Column, facts: Column) -> Column:
    """ALG16: whether neither the stem nor the keyed option names the concept."""
    a, b = T.plain(stem), T.plain(keyed)
    return bound(concept_aliases(name, facts), lambda x: (F.size(x) > 0) & ~F.exists(x, lambda n: T.mentions(a, n) | T.mentions(b, n)))


def inferred_answer(options: Column, answer: Column, explanation: Column) -> Column:
    """ALG17: the option that an explanation names though it doesn't name the key, -1 if there is none or it is not clear."""
    opening = F.get(F.split(explanation, rf"(?<=[.!?]){S}+"), 0)
    # unlike ALG15, the texts aren't made plain: an alias meets them word for word
    named = lambda t, a, end=L: F.rlike(t, F.concat(F.lit(end), F.regexp_replace(a, " ", r"\\s+"), F.lit(R)))

    def facts(o: Column, i: Column, text: Column, lead: Column) -> Column:
        return bound(T.option_aliases(o), lambda al: F.struct(i.alias("i"), F.exists(al, lambda a: named(text, a)).alias("any"), F.exists(al, lambda a: named(lead, a)).alias("early"), F.exists(al, lambda a: named(lead, a, "^")).alias("starts")))

    def told(m: Column, first: Column) -> Column:
        praises = first.rlike(rf"(?i){L}(is correct|correct because|best answer|primarily responsible|primarily explains|directly affects|defined as|refers to){R}")
        blames = first.rlike(rf"(?i){L}(tempting|fails because|incorrect|wrong|whereas|however|unlike|in contrast|not because){R}")
        others = F.filter(m, lambda x: x["i"] != answer)
        leads, found = F.filter(others, lambda x: x["starts"] | (x["early"] & praises)), F.filter(others, lambda x: x["any"])
        return F.when(F.coalesce(F.get(m, answer)["any"], F.lit(False)), -1).when((F.size(leads) > 0) & ~blames, F.get(leads, 0)["i"]).when(F.size(found) == 1, F.get(found, 0)["i"]).otherwise(-1)

    return F.when(missing(explanation) | (F.size(options) == 0), -1).otherwise(bound(opening, lambda first: bound(F.struct(F.lower(explanation).alias("text"), F.lower(first).alias("lead")), lambda x: bound(F.transform(options, lambda o, i: facts(o, i, x["text"], x["lead"])), lambda m: told(m, first)))))


def evidence_offsets(quote: Column, source: Column) -> Column:
    """ALG06: struct(start, end) of the quote in the source, counted in code points from 0; of the first place that is alike but for white space, case and typographic signs, if there is no exact one; null if none.

    The normal form maps signs one to one and shrinks white space, so a place in it is found again by the number of
    signs that aren't white space before it.
    """
    exact = F.instr(source, quote)
    want, there = T.search_text(quote), T.search_text(source)
    at = F.instr(there, want)
    dense = lambda c: F.length(F.regexp_replace(c, f"{S}", ""))
    before, size = dense(F.substring(there, F.lit(1), at - 1)), dense(want)
    signs = F.filter(F.transform(F.split(source, ""), lambda ch, i: F.when(~ch.rlike(S), i)), lambda i: i.isNotNull())
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(missing(quote) | source.isNull(), None).when(exact > 0, span(exact - 1, exact - 1 + F.length(quote))).when((want != "") & (at > 0), bound(signs, lambda x: span(F.get(x, before), F.get(x, before + size - 1) + 1)))


def evidence_sentences(c: Column) -> Column:
    """STR19: sentences of thirty letters at least that are no embedded questions."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"(?<=[.!?]){S}+|\n+"), trimmed), lambda s: (F.length(s) >= 30) & ~T.is_embedded_mcq(s))


def clue_span(clue: Column, quote: Column) -> Column:
    """WIN07: the longest run of 2 to 14 words of the clue that the quote holds, as it stands there; null where the clue stays as it is."""

    def best(ws: Column, quoted: Column, low: Column) -> Column:
        n = F.size(ws)
        runs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda a: F.transform(F.reverse(F.sequence(F.lit(2), F.least(F.lit(14), n - a + 1))), lambda k: F.array_join(F.slice(ws, a, k), " "))))
        held = F.filter(runs, lambda r: F.contains(low, r))
        return bound(F.array_max(F.transform(held, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"], lambda r: F.when(r.isNotNull(), trimmed(F.substring(quoted, F.instr(low, r), F.length(r)))))

    def span(quoted: Column, low: Column, said: Column) -> Column:
        return F.when((said != "") & ~F.contains(low, said), bound(T.words(said), lambda ws: F.when(F.size(ws) >= 2, best(ws, quoted, low))))

    said = trimmed(F.regexp_replace(F.lower(trimmed(clue)), "[.,;:!?]+$", ""))
    return F.when(~missing(quote) & ~missing(clue), bound(trimmed(quote), lambda quoted: bound(F.struct(F.lower(quoted).alias("low"), said.alias("said")), lambda x: span(quoted, x["low"], x["said"]))))


def too_similar(a: Column, b: Column) -> Column:
    """STR33: equal or one within the other, or over 0.65 of the shorter one's telling words."""
    x, y = T.option_text(a), T.option_text(b)
    tokens = lambda t: F.filter(F.split(t, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*OPTION_NOISE))
    p, q = tokens(x), tokens(y)
    shared = F.size(F.filter(p, lambda w: F.array_contains(q, w)))
    return F.when((x == "") | (y == ""), False).when(F.contains(x, y) | F.contains(y, x), True).otherwise(F.coalesce(shared / F.nullif(F.least(F.size(p), F.size(q)), F.lit(0)) > 0.65, F.lit(False)))


def definition_score(candidate: Column, name: Column) -> Column:
    """MTH17."""
    n = lambda c: F.size(F.filter(F.split(T.option_text(c), " "), lambda w: F.length(w) >= 3))
    bracket, slash = (lambda c: c.rlike(r"\([^)]+\)")), (lambda c: F.contains(c, F.lit("/")))
    return 10 - F.least(F.abs(n(candidate) - n(name)), F.lit(6)) - F.when(bracket(candidate) != bracket(name), 3).otherwise(0) - F.when(slash(candidate) != slash(name), 2).otherwise(0)


def simple_explanation(explanation: Column, answer: Column) -> Column:
    """STR34: without an opening that only repeats the answer."""
    a, t = trimmed(answer), trimmed(explanation)
    first = F.get(F.split(t, rf"(?<=[.!?]){S}+"), 0)
    rest = lambda skipped: bound(trimmed(F.regexp_replace(F.substring(t, F.length(skipped) + 1, F.length(t)), r"^[:\s,.;-]+", "")), lambda r: F.when(r != "", F.concat(F.lit("This is correct because: "), r)).otherwise(F.concat(F.lit("Why this answer? "), a, F.lit("."))))
    split = lambda c: F.filter(F.split(T.label(c), " "), lambda w: w != "")
    return F.when((a == "") | (t == ""), t).when(F.startswith(T.label(t), T.label(a)), rest(a)).when(T.overlap_share(split(first), split(a), F.greatest) >= 0.8, rest(first)).otherwise(t)


def sentence_score(sentence: Column, keywords: Column) -> Column:
    """STR43: how well a sentence of sound shape speaks of the keywords; 0 if its shape is at fault."""
    return bound(split_keywords(keywords), lambda known: score_of(sentence, known))


def split_keywords(keywords: Column) -> Column:
    """Plain keywords with their words, for score_of."""
    return F.transform(F.filter(F.transform(keywords, T.plain), lambda k: k != ""), lambda k: F.struct(k.alias("k"), F.split(k, " ").alias("ws")))


def score_of(sentence: Column, known: Column) -> Column:
    """STR43. known: of split_keywords."""

    def gain(said: Column, x: Column) -> Column:
        met = F.size(F.filter(x["ws"], lambda w: F.contains(said, w)))
        return F.when(F.contains(said, x["k"]), F.greatest(F.lit(4), F.size(x["ws"]))).otherwise(bound(met, lambda m: F.when(m >= F.greatest(F.lit(2), F.ceil(F.size(x["ws"]) / 2)), m).otherwise(0)))

    heading = sentence.rlike("^[A-Z][A-Za-z0-9 ,:/()-]{0,90}$") & ~sentence.rlike("[.!?]$")
    total = lambda said: F.aggregate(F.transform(known, lambda x: gain(said, x)), F.lit(0).cast("long"), lambda a, g: a + g) + F.when(F.size(T.words(sentence)) >= 10, 1).otherwise(0) - F.when(heading, 2).otherwise(0)
    return F.when(T.quote_fault(sentence).isNotNull(), 0).otherwise(bound(T.plain(sentence), lambda said: F.when(said == "", 0).otherwise(total(said)))).cast("long")


def better_sentence(source: Column, quote: Column, keywords: Column) -> Column:
    """STR43: the first sentence of the source of the highest score, if that is above the quote's own; the quote otherwise."""

    def choose(known: Column) -> Column:
        scored = F.transform(evidence_sentences(source), lambda s, i: F.struct(score_of(s, known).alias("n"), (-i).alias("i"), s.alias("s")))
        own = F.when(missing(quote), F.lit(0).cast("long")).otherwise(score_of(quote, known))
        return bound(F.array_max(scored), lambda b: F.when(b["n"] > own, b["s"]).otherwise(quote))

    return bound(split_keywords(keywords), choose)


def aligned_quote(quote: Column, source: Column) -> Column:
    """ALG18: the sentence of the source that holds the quote, else the first of the most shared words of four letters, if at least 0.4 of the shorter one's are; else the quote."""
    long = lambda c: F.filter(F.split(T.plain(c), " "), lambda w: F.length(w) >= 4)

    def likest(ss: Column, q: Column) -> Column:
        best = lambda ws: F.array_max(F.transform(ss, lambda s, i: F.struct(T.overlap_share(ws, long(s)).alias("n"), (-i).alias("i"), s.alias("s"))))
        return bound(bound(long(q), best), lambda b: F.when(b["n"] >= 0.4, b["s"]))

    def choose(ss: Column, q: Column) -> Column:
        return F.coalesce(F.get(F.filter(ss, lambda s: F.contains(s, q)), 0), likest(ss, q), quote)

    lacks = lambda q: (q == "") | (q == "UNGROUNDED") | (trimmed(F.coalesce(source, F.lit(""))) == "")
    return bound(trimmed(F.coalesce(quote, F.lit(""))), lambda q: F.when(lacks(q), quote).otherwise(bound(evidence_sentences(source), lambda ss: choose(ss, q))))


def nearest_distractor(options: Column, answer: Column) -> Column:
    """ALG18: the wrong option that is most like the key, the first of equals; null without a key or a wrong option."""
    key = F.get(options, answer)
    scored = F.transform(options, lambda o, i: F.when(i != answer, F.struct(T.option_similarity(o, key).alias("n"), (-i).alias("i"), o.alias("o"))))
    return F.when(~missing(key), F.array_max(F.filter(scored, lambda x: x.isNotNull()))["o"])


def repaired_draft(quote: Column, options: Column, answer: Column, clue: Column, explanation: Column, concept: Column, source: Column) -> Column:
    """ALG18: struct(quote, distractor, clue, answer) of a draft: the quote becomes a sentence of the source, the distractor the wrong option most like the key, the clue a run of the quote, the answer the option that the explanation speaks for, and a quote that isn't of the clue, key and concept gives way to a better sentence."""

    def first(o: Column, q: Column) -> Column:
        told = inferred_answer(o, answer, F.coalesce(explanation, F.lit("")))
        a = bound(told, lambda t: F.when(t >= 0, t).otherwise(answer))
        return F.struct(o.alias("o"), F.coalesce(trimmed(q), F.lit("")).alias("q"), F.coalesce(clue_span(clue, q), clue).alias("c"), a.cast("int").alias("a"))

    def upgraded(x: Column, keywords: Column) -> Column:
        sound = (F.length(x["q"]) >= 20) & F.contains(source, x["q"]) & (sentence_score(x["q"], keywords) > 1)
        return F.when(F.coalesce(sound, F.lit(False)) | (F.size(keywords) == 0) | (trimmed(source) == ""), x["q"]).otherwise(better_sentence(source, x["q"], keywords))

    def last(x: Column, nq: Column) -> Column:
        return F.struct(nq.alias("quote"), nearest_distractor(x["o"], answer).alias("distractor"), F.coalesce(clue_span(x["c"], nq), x["c"]).alias("clue"), x["a"].alias("answer"))

    words = lambda x: F.filter(F.array(F.coalesce(x["c"], F.lit("")), F.coalesce(F.get(x["o"], x["a"]), F.lit("")), trimmed(F.coalesce(concept, F.lit("")))), lambda k: k != "")
    start = bound(F.transform(options, T.without_label), lambda o: bound(aligned_quote(quote, source), lambda q: first(o, q)))
    return bound(start, lambda x: bound(bound(words(x), lambda keywords: upgraded(x, keywords)), lambda nq: last(x, nq)))


# Fixed value: signs of a clinical presentation.
CLINICAL = "patient|presents?|year.old|male|female|complain|symptom|sign|vital|lab|imaging|exam|diagnosis|management|treatment|history|physical|workup|finding|fever|pain|dyspnea|fatigue|nausea|vomiting|diarrhea|rash|edema|tachycardia|bradycardia|hypertension|hypotension|biopsy|CBC|BMP|CXR|CT|MRI|EKG|ECG"


def clinical_support(c: Column) -> Column:
    """STR40 with QRK01: a sign counts 2 however often there are signs, so a text of up to 400 words with any sign passes."""
    hits = F.when(c.rlike(rf"(?i){L}({CLINICAL}){R}"), 2).otherwise(0)
    return hits >= F.greatest(F.lit(2.0), F.size(F.split(c, f"{S}+")) / 200)


def shared_feature(category: Column, domain: Column, candidate: Column) -> Column:
    """STR41."""
    return (
        F.when(category.rlike("(?i)mechanism|pathway|physiology") | domain.rlike("(?i)mechanism|causal"), "same mechanistic comparison class")
        .when(category.rlike("(?i)drug|pharmacology"), "same therapeutic/pharmacologic comparison class")
        .when(category.rlike("(?i)condition|presentation|complication|association"), "same clinical differential neighborhood")
        .otherwise(F.concat(F.lower(category), F.lit(" comparison class shared with "), candidate))
    )


def differentiator(category: Column, domain: Column, name: Column, candidate: Column, reason: Column) -> Column:
    """STR41."""
    between = F.concat(name, F.lit(" from "), candidate)
    return (
        F.when(~missing(reason), reason)
        .when(category.rlike("(?i)mechanism|pathway|physiology") | domain.rlike("(?i)mechanism|causal"), F.concat(F.lit("the deciding clue separates "), between, F.lit(" at the mechanism level")))
        .when(category.rlike("(?i)drug|pharmacology"), F.concat(F.lit("the stem must distinguish "), between, F.lit(" by indication, adverse effect, or mechanism")))
        .otherwise(F.concat(F.lit("the stem must distinguish "), between, F.lit(" using one clinically meaningful feature")))
    )
