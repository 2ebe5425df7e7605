"""Text rules for questions, options, quotes and labels, as Column functions.

Java's \\s, \\b and \\w differ from other engines' outside ASCII, so white space and word edges are spelled out. Each rule
is a function of its own, for the rules differ in small ways that matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, and edges of ASCII words.
S = r"[ \t\n\r\f\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACES = " \t\n\r\f\x0b\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # the signs of S
L, R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# The word lists of the rules.
STOP_WORDS = """a an the and or but of to in on for with by at from into during including until against among throughout
despite towards upon about over under after before between without within along following across behind beyond plus
except up out around down off above near is are was were be been being which what how why when where who whom this that
these those his her their its your our best most likely""".split()
EVIDENCE_STOP_WORDS = "which their there these those because during through between within without about after before under above below other into from that this with have been they them than then".split()
DESCRIPTORS = "level levels rate rates measurement measurements evaluation testing analysis profiling assessment concentration value reading index ratio".split()
BROAD_LABELS = "activity control function mechanism mechanisms process processes regulation response structure structures".split()
ACTIONS = "administer give start stop order perform refer consult monitor treat".split()
DIAGNOSES = "syndrome disease disorder itis osis emia uria pathy".split()
ANATOMY = "muscle nerve duct tubule glomerulus vessel artery vein capillary cortex medulla pelvis ureter bladder sphincter nephron loop gland lobe capsule node valve receptor cell".split()
MECHANISMS = "filtration reabsorption secretion regulation compliance excretion absorption transport diffusion inhibition activation pathway reflex mechanism cystometrogram urodynamic electromyograph uroflowmetr".split()
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "‘’‚‛′‵", "“”„‟″‶", "–—―"


def bound(value: Column, f) -> Column:
    """f of the value, which is computed once and not again for each use within a lambda function."""
    return F.get(F.transform(F.array(value), f), 0)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeezed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{S}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{S}+"), lambda w: w != "")


def plain(c: Column) -> Column:
    """Lower case, ASCII letters and digits, single spaces (STR04)."""
    return label(c)  # a run of other signs, white space among them or not, is one space either way


def label(c: Column) -> Column:
    """STR08: runs of other signs are one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def ascii_quotes(c: Column) -> Column:
    return F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))


def evidence_text(c: Column) -> Column:
    """STR05: typographic signs, white space and repeated punctuation made plain."""
    one = F.regexp_replace(F.regexp_replace(ascii_quotes(c), f"{S}+", " "), "([.,;:!?])[.,;:!?]+", "$1")
    return F.trim(F.lower(one))


def search_text(c: Column) -> Column:
    """STR06: as STR05, but punctuation stays."""
    return F.trim(F.lower(F.regexp_replace(ascii_quotes(c), f"{S}+", " ")))


def copy_text(c: Column) -> Column:
    """STR07: words parted at line ends are joined again."""
    joined = F.regexp_replace(c, rf"([A-Za-z]{{2,}}){S}*-{S}+([a-z]{{2,}})", "$1$2")
    return F.trim(F.regexp_replace(F.lower(ascii_quotes(joined)), "[^a-z0-9]+", " "))


def without_label(c: Column) -> Column:
    """STR10: an option without its letter."""
    return trimmed(F.regexp_replace(c, rf"^{S}*[A-Ea-e][.)]{S}*", ""))


def option_text(c: Column) -> Column:
    """STR09."""
    return plain(F.regexp_replace(F.lower(c), rf"^[a-e][.)]{S}*", ""))


def singular(c: Column) -> Column:
    """STR11, for one token."""
    n = F.length(c)
    return (
        F.when(c.endswith("ies") & (n > 4), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when(c.endswith("ses") & (n > 4), F.substring(c, F.lit(1), n - 2))
        .when(c.endswith("s") & ~c.endswith("ss") & (n > 3), F.substring(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def singular_text(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), singular), " ")


def option_aliases(c: Column) -> Column:
    """STR12: the option, without and with only its brackets, and the singular of each."""

    def base(own: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(own, F.lit(r"\(([^)]+)\)"), 1), plain)
        return F.concat(F.array(plain(own), plain(F.regexp_replace(own, r"\([^)]*\)", " "))), inner)

    return bound(bound(without_label(c), base), lambda b: F.filter(F.array_distinct(F.concat(b, F.transform(b, singular_text))), lambda x: x != ""))


def mentions(text: Column, alias: Column) -> Column:
    """STR14, on plain texts: the alias as whole words."""
    return (alias != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), alias, F.lit(" ")))


def stem_tokens(c: Column) -> Column:
    """STR01."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(plain(c), " "), lambda w: (w != "") & ~F.array_contains(stop, w))


def fingerprint(c: Column) -> Column:
    """STR02: the first twelve tokens."""
    return F.array_join(F.slice(stem_tokens(c), 1, 12), " ")


def merge_key(name: Column, category: Column) -> Column:
    """STR15."""
    return F.concat(F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, 30), F.lit("|"), F.substring(F.regexp_replace(F.lower(category), "[^a-z]", ""), 1, 10))


def slug(c: Column) -> Column:
    """STR17."""
    s = F.regexp_replace(F.regexp_replace(trimmed(F.lower(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 48), F.lit("")), F.lit("bank"))


def is_embedded_mcq(c: Column) -> Column:
    """STR20."""
    asks = lambda t, said: F.contains(t, F.lit(said)) & t.rlike(rf"{L}{said}{R}.*\?$")
    listed = c.rlike(rf"^{S}*[A-E]{S}+[A-Za-z0-9_].{{5,}}{S}+[B-E]{S}+[A-Za-z0-9_]")
    return bound(trimmed(c), lambda t: listed | asks(t, "Which of the following") | asks(t, "What is the most likely"))


def is_negation(c: Column) -> Column:
    """STR24."""
    return c.rlike(rf"(?i){L}(not|except|least){R}")


def opens_with_case(c: Column) -> Column:
    """STR24: the opening of a level-3 stem."""
    return c.rlike(rf"(?i)^{S}*A{S}+\d{{1,3}}-year-old{S}+(male|female){S}+present")


def is_interrogative(c: Column) -> Column:
    """STR23: a question mark at the end (a citation may follow), or a last sentence that opens like a question."""
    t = trimmed(F.regexp_replace(trimmed(c), rf"(?:{S}*\([^)]*\){S}*)+$", ""))
    last = trimmed(F.element_at(F.split(t, rf"(?<=[.!?]){S}+"), -1))
    return (trimmed(c) != "") & (t.rlike(rf"\?{S}*$") | last.rlike(rf"(?i)^(which|what|how|why|when|where|identify|select the|choose the){R}"))


def quote_fault(c: Column) -> Column:
    """STR25: name of the first rule that a quote breaks; null if none or empty."""

    def by_signs(t: Column, n: Column, ends: Column) -> Column:
        pages = F.regexp_count(t, F.lit(rf"{L}\d{{3,4}}{R}"))
        return (
            F.when(ends > 1, "several sentences")
            .when((ends == 0) & (n < 18), "no sentence")
            .when((pages >= 3) & (pages / n > 0.07), "contents page")
            .when(t.rlike(rf"{L}[A-E]{S}+[A-Z][a-z].{{3,}}{S}+[B-E]{S}+[A-Z]"), "option list")
            .when(t.rlike(rf"{L}(Which of the following|What is the most likely){R}.*\?$"), "question stem")
        )

    def by_words(t: Column, n: Column) -> Column:
        return F.when(n < 10, "too short").when(n > 35, "too long").otherwise(bound(F.regexp_count(t, F.lit(rf"[.!?](?={S}|$)")), lambda ends: by_signs(t, n, ends)))

    return bound(trimmed(c), lambda t: F.when(t == "", None).when(t.rlike("^[-–—a-z]"), "fragment").otherwise(bound(F.size(words(t)), lambda n: by_words(t, n))))


def coverage_domain(name: Column, category: Column) -> Column:
    """STR28: the first class one of whose words the name or the category holds."""
    n, c = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    has = lambda x, ws: F.lit(False) if not ws else x.rlike("|".join(ws))
    return (
        F.when(has(c, ["mechanism"]) | has(n, ["mechanism", "pathway", "regulation", "physiology"]), "mechanism_causal")
        .when(has(n, ["pressure", "volume", " flow", "resistance", "compliance", "cardiac output", "gradient", "starling"]), "pressure_volume_quantitative")
        .when(has(c, ["complication", "classic association"]) | has(n, [" versus ", " vs ", "differential", "distinction", "comparison"]), "comparison_differential")
        .when(has(c, ["clinical presentation", "treatment", "diagnostic method", "drug", "pharmacology"]) | has(n, ["management", "presentation", "diagnosis", "therapy", "treatment"]), "clinical_application")
        .otherwise("entity_recall")
    )


def overlap_share(a: Column, b: Column, over=F.least) -> Column:
    """Shared distinct items over the smaller set (STR31), or the larger one with over=F.greatest (STR32); 0 if one is empty."""

    def share(x: Column, y: Column) -> Column:
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / over(F.size(x), F.size(y)))

    return bound(F.array_distinct(a), lambda x: bound(F.array_distinct(b), lambda y: share(x, y)))


def option_similarity(a: Column, b: Column) -> Column:
    long = lambda c: F.filter(words(option_text(c)), lambda w: F.length(w) >= 4)
    return overlap_share(long(a), long(b))


def clause_match(quote: Column, source: Column) -> Column:
    """STR30: confidence of a quote whose clauses the source holds; null if they don't reach 85 %."""
    return clauses_held(quote, evidence_text(source))


def clauses_held(quote: Column, text: Column) -> Column:
    """STR30 on the evidence text of a source."""
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))

    def judged(clauses: Column, hit: Column) -> Column:
        share = F.try_divide(chars(hit), chars(clauses))
        return F.when((F.size(hit) == F.size(clauses)) | (share >= 0.85), F.greatest(F.lit(0.84), F.least(F.lit(0.9), share)))

    def met(clauses: Column) -> Column:
        hits = bound(text, lambda t: F.filter(clauses, lambda x: F.contains(t, x)))
        return F.when(F.size(clauses) >= 2, bound(hits, lambda hit: judged(clauses, hit)))

    return bound(F.filter(F.transform(F.split(quote, "[;•]"), evidence_text), lambda x: F.length(x) >= 12), met)


def evidence_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"{L}[a-z0-9][a-z0-9'-]*(?<=[a-z0-9]){R}"), 0)


def content_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.isin(*EVIDENCE_STOP_WORDS))


def pairs_of(tokens: Column) -> Column:
    """WIN05: neighbouring words."""
    return bound(tokens, lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)))).otherwise(F.array().cast("array<string>")))


def fuzzy_ratio(quote: Column, source: Column) -> Column:
    """WIN04: the best share of the quote's content word pairs that a window of its length holds. Pairs in the window count as often as they stand there, so it may exceed 1."""

    def best(x: Column) -> Column:
        q, s, wanted = x["q"], x["s"], x["pairs"]
        size = F.size(q)
        step = F.greatest(F.lit(1), F.floor(size * 0.25)).cast("int")
        hits = lambda i: F.size(F.filter(pairs_of(content_words(F.slice(s, i, size))), lambda p: F.array_contains(wanted, p)))
        rates = F.transform(F.sequence(F.lit(1), F.size(s) - size + 1, step), lambda i: hits(i) / F.size(wanted))
        fit = (size >= 4) & (F.size(s) >= size) & (F.size(wanted) >= 1)
        return F.when(fit, F.array_max(rates)).otherwise(0.0)

    q = evidence_words(evidence_text(quote))
    return bound(F.struct(q.alias("q"), evidence_words(evidence_text(source)).alias("s"), F.array_distinct(pairs_of(content_words(q))).alias("pairs")), best)


def anchor_support(anchor: Column, source: Column) -> Column:
    """STR29: two shared words, or half of the anchor's."""
    tokens = lambda c: F.array_distinct(content_words(F.split(evidence_text(c), " ")))
    a, b = tokens(anchor), tokens(source)
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ((shared >= 2) | (shared / F.size(a) >= 0.5)), F.lit(False))


def evidence(quote: Column, source: Column, fuzzy: bool = True, start: Column | None = None, end: Column | None = None) -> Column:
    """ALG05: struct of type and confidence. exact, normalized, by clauses, fuzzy from 0.6; if start and end (places of signs, from 0) are given, last by what stands there."""
    q = evidence_text(quote)
    made = lambda t, c: F.struct(F.lit(t).alias("type"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"))
    last = made("none", 0.0)
    if start is not None:
        there = evidence_text(F.substring(source, start + 1, end - start))
        last = F.when((start >= 0) & (end > start) & (F.substring(source, start + 1, end - start) != "") & (there == q), made("normalized", 0.85)).otherwise(last)
    if fuzzy:
        after = last
        last = bound(F.when(F.length(quote) >= 20, fuzzy_ratio(quote, source)), lambda ratio: F.when(ratio >= 0.6, made("fuzzy", ratio)).otherwise(after))
    by_clauses = lambda text: bound(clauses_held(quote, text), lambda clause: F.when(clause.isNotNull(), made("normalized", clause)).otherwise(last))
    return (
        F.when(quote.isNull() | (quote == "UNGROUNDED") | (F.length(quote) < 15) | source.isNull() | (source == ""), made("none", 0.0))
        .when(F.contains(source, quote), made("exact", 1.0))
        .otherwise(bound(evidence_text(source), lambda text: F.when(F.contains(text, q), made("normalized", 0.9)).otherwise(by_clauses(text))))
    )


def verdict(issues: Column) -> Column:
    """ALG14: the first group of rules that an issue belongs to; null without issues, DETERMINISTIC_VALIDATION (a rejection) if none fits."""
    low = F.transform(issues, F.lower)
    has = lambda *ps: F.exists(low, lambda i: i.rlike("|".join(ps)))
    return (
        F.when(F.size(issues) == 0, None)
        .when(has("source quote", "grounded source quote", "quoted pdf evidence", "deciding clue is not clearly supported", "correct answer is not clearly supported"), "EVIDENCE_GROUNDING")
        .when(has("option lengths create", "correct answer.*longer than average", "trim the correct answer", "expand distractors"), "OPTION_SET_HOMOGENEITY")
        .when(has("unique qualifier", "overly overlapping", "mix conceptual categories", "all of the above", "most tempting distractor"), "OPTION_SET_HOMOGENEITY")
        .when(has("decision target metadata", "deciding clue metadata", "whytempting", "whyfails", "explanation is too short"), "CLINICAL_PEDAGOGY")
        .when(has("level 1 questions should avoid negation", "level 3 questions must open", "under-specified"), "STEM_LEVEL_FIDELITY")
        .otherwise("DETERMINISTIC_VALIDATION")
    )


def key_mismatch(options: Column, answer: Column, explanation: Column) -> Column:
    """ALG15: the option that an explanation speaks for though another one is the key; null if none."""
    opening = F.get(F.split(explanation, rf"(?<=[.!?]){S}+"), 0)

    def facts(o: Column, i: Column, text: Column, lead: Column) -> Column:
        return bound(option_aliases(o), lambda al: F.struct(
            i.alias("i"), o.alias("option"), F.size(F.filter(al, lambda a: mentions(text, a))).alias("n"), F.exists(al, lambda a: mentions(lead, a)).alias("early"),
            F.exists(al, lambda a: F.startswith(F.concat(lead, F.lit(" ")), F.concat(a, F.lit(" ")))).alias("starts")))

    def told(m: Column, first: Column, text: Column) -> Column:
        praises = first.rlike(rf"(?i){L}(is correct|correct because|best answer|primarily responsible|primarily explains|directly affects|defined as|refers to){R}")
        blames = first.rlike(rf"(?i){L}(tempting|fails because|incorrect|wrong|whereas|however|unlike|in contrast|not because){R}")
        key, others = F.get(m, answer), F.filter(m, lambda x: x["i"] != answer)
        leads = F.filter(others, lambda x: x["starts"] | (x["early"] & praises))
        most = F.array_max(F.transform(others, lambda x: x["n"]))
        main = F.get(F.filter(others, lambda x: x["n"] == most), 0)["option"]
        return F.when(key.isNull() | (text == ""), None).when((F.size(leads) > 0) & ~blames & ~key["early"], F.get(leads, 0)["option"]).when((key["n"] == 0) & (F.length(text) > 20) & (most > 0), main)

    said = bound(opening, lambda first: F.struct(first.alias("first"), plain(explanation).alias("text"), plain(first).alias("lead")))
    return bound(said, lambda x: bound(F.transform(options, lambda o, i: facts(o, i, x["text"], x["lead"])), lambda m: told(m, x["first"], x["text"])))


def is_copied_stem(stem: Column, source: Column) -> Column:
    """WIN06: a run of min(28, max(18, 45 % of its words)) words of a question stem stands in the source."""
    asks = stem.rlike(rf"\?|(?i){L}which of the following{R}|(?i){L}what is (the )?most likely{R}|(?i){L}most likely to be (recorded|observed|seen|found|present){R}|(?i){L}[a-z]-year-old{S}+(man|woman|male|female|boy|girl){R}")

    def runs_held(tokens: Column, text: Column) -> Column:
        run = F.least(F.lit(28), F.greatest(F.lit(18), F.floor(F.size(tokens) * 0.45))).cast("int")
        starts = lambda n: F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return bound(run, lambda n: F.exists(starts(n), lambda i: F.contains(text, F.array_join(F.slice(tokens, i, n), " "))))

    held = lambda s, text: F.contains(text, s) | bound(F.split(s, " "), lambda tokens: runs_held(tokens, text))
    return asks & bound(copy_text(stem), lambda s: (F.length(s) >= 80) & bound(F.concat(F.lit(" "), copy_text(source), F.lit(" ")), lambda text: held(s, text)))


def length_fault(options: Column, answer: Column) -> Column:
    """MTH10: whether an option set's lengths tell: longest over shortest above 1.6, or the key longest and above 1.3 of the (upper) median, or shortest and below 0.7."""
    n = F.transform(options, lambda o: F.length(trimmed(o)))
    key, ordered = F.get(n, answer), F.array_sort(n)
    middle, low, high = F.get(ordered, F.floor(F.size(n) / 2).cast("int")), F.array_min(n), F.array_max(n)
    tells = (high / low > 1.6) | ((key == high) & (key / middle > 1.3)) | ((key == low) & (key / middle < 0.7))
    return F.coalesce(F.when((low > 0) & key.isNotNull(), tells), F.lit(False))


def option_flags(options: Column, answer: Column) -> Column:
    """ARR03: the flags of an option set, in the order of the rules."""
    n = F.size(options)
    held = lambda ws: F.size(F.filter(options, lambda o: o.rlike(rf"(?i){L}({'|'.join(ws)}){R}")))
    tokens = F.transform(options, lambda o: F.split(trimmed(o), f"{S}+"))
    lens = F.transform(tokens, F.size)
    brackets = F.filter(options, lambda o: o.rlike(r"\([^)]+\)"))
    key = F.coalesce(F.get(options, answer), F.lit(""))
    key_len = F.size(F.split(trimmed(key), f"{S}+"))
    others = F.filter(F.transform(lens, lambda x, i: F.when(i != answer, x)), lambda x: x.isNotNull())
    mean = F.coalesce(F.try_divide(F.aggregate(others, F.lit(0), lambda s, x: s + x), F.size(others)), F.lit(0.0))
    last = F.transform(tokens, lambda t: F.lower(F.element_at(t, -1)))
    ends_in = lambda ws: F.size(F.filter(F.transform(options, lambda o: F.split(F.lower(trimmed(o)), f"{S}+")), lambda t: (F.size(t) >= 3) & F.element_at(t, -1).isin(*ws))) >= F.ceil(n * 0.6)
    long = F.transform(options, lambda o: F.array_distinct(F.filter(F.split(F.lower(o), f"{S}+"), lambda w: F.length(w) > 3)))
    both = lambda i, j: F.size(F.array_intersect(F.get(long, i), F.get(long, j)))
    least = lambda i, j: F.greatest(F.lit(1), F.least(F.size(F.get(long, i)), F.size(F.get(long, j))))
    places = lambda a: F.when(a <= n - 1, F.sequence(a, n - 1)).otherwise(F.array().cast("array<int>"))
    overlaps = F.flatten(F.transform(places(F.lit(0)), lambda i: F.transform(F.filter(places(i + 1), lambda j: (both(i, j) > 0) & (both(i, j) / least(i, j) > 0.65)), lambda j: F.concat(F.lit("OPTION_OVERLAP_"), i.cast("string"), F.lit("_"), j.cast("string")))))
    flag = lambda name, rule: F.when(rule, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        flag("NONE_ALL_OF_ABOVE", F.exists(options, lambda o: o.rlike("(?i)all of the above|none of the above"))),
        flag("MIXED_CATEGORY", (held(ACTIONS) >= 2) & (held(DIAGNOSES) >= 2)),
        flag("LENGTH_OUTLIER", (n >= 3) & (F.array_max(lens) > F.array_min(lens) * 2.5)),
        flag("UNIQUE_QUALIFIER", (F.size(brackets) == 1) & key.rlike(r"\([^)]+\)")),
        overlaps,
        flag("CORRECT_LONGER_TELL", (key_len > mean * 1.3) & (key_len - mean > 4)),
        flag("SHARED_SUFFIX", (n >= 3) & (F.length(F.get(last, 0)) >= 4) & (F.size(F.array_distinct(last)) == 1)),
        flag("DESCRIPTOR_SUFFIX", (n >= 3) & ends_in(DESCRIPTORS)),
        flag("GENERIC_LABEL_SUFFIX", (n >= 3) & ends_in(BROAD_LABELS)),
        flag("ANATOMY_MECHANISM_MIX", (held(ANATOMY) >= 2) & (held(MECHANISMS) >= 2)),
    )


def answer_index(c: Column) -> Column:
    """STR39: a number, or a letter from A to E; 0 otherwise."""
    t = trimmed(c)
    return F.when(t.rlike(r"^\d{1,9}$"), t.try_cast("int")).when(F.upper(t).rlike("^[A-E]$"), F.ascii(F.upper(t)) - 65).otherwise(0)


def question_level(c: Column) -> Column:
    return F.when(c.isin("2", "L2"), 2).when(c.isin("3", "L3"), 3).otherwise(1)


def cosine(a: Column, b: Column) -> Column:
    """MTH01: 0 for empty vectors, unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
