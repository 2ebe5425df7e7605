"""ALG20: drafts whose options are definitions become questions for a named concept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, option_text, trimmed, words
from .validation import definition_score, too_similar

# Openings of an option that is a definition, and of a distractor that is one; domains; texts.
DEFINITION_OPTION = r"(?i)^(the\s+|ability\s+of|capacity\s+of|increase\s+in)"
DEFINITION_DISTRACTOR = r"(?i)^(the\s+(ability|capacity|increase|resistance|pressure|rate)|ability\s+of|capacity\s+of)"
DOMAINS = ("definition_recall", "pressure_volume_quantitative")
RELATED_NAMES = r"(?i)pressure|volume|compliance|distensibility|pulse|venous|arterial|reservoir"
NO_CLUE = "In the source passage, which named concept matches the clue described in this stem?"
STEM = ("In the source passage, which named concept is described by \"", "\"?")
NEARBY = " is a nearby pressure-volume concept from the same chapter."
FAILS, FAILS_STEM = " does not match the defining clue: ", " does not match the defining clue in the stem."
EXPLAINED = (" is correct because it matches the defining clue in the stem. ", " is tempting because ", ", but fails because ")
#: Options of a level 1 question, the place of an answer without a valid one, signs of a clue in the stem.
OPTIONS, MIDDLE, CLUE = 5, 2, 140


def is_definition_soup(level: Column, domain: Column, options: Column) -> Column:
    """Whether all options but one, three at least, are long definitions, in a domain of definitions, at level 1."""
    soup = F.size(F.filter(options, lambda o: (F.size(words(o)) >= 6) & trimmed(o).rlike(DEFINITION_OPTION)))
    return F.coalesce((level == 1) & domain.isin(*DOMAINS) & (F.size(options) >= 4) & (soup >= F.greatest(F.lit(3), F.size(options) - 1)), F.lit(False))


def different(texts: Column, name: Column, keyed: bool) -> Column:
    """The texts without blanks, repeats (by their plain form) and the concept's own name; keyed: texts without any plain sign go too."""
    plain = F.filter(F.transform(texts, lambda t: bound(trimmed(t), lambda x: F.struct(x.alias("t"), option_text(x).alias("k")))), lambda x: (x["t"] != "") & (x["k"] != option_text(name)) & ((x["k"] != "") | F.lit(not keyed)))
    return bound(plain, lambda a: F.transform(F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: y["k"] == x["k"])), lambda x: x["t"]))


def picked(candidates: Column, name: Column) -> Column:
    """OPTIONS - 1 distractors: those nearest to the name in shape that aren't alike, then any others in this order."""
    need = OPTIONS - 1
    ranked = F.transform(F.array_sort(F.transform(candidates, lambda t, i: F.struct((-definition_score(t, name)).alias("s"), i.alias("i"), t.alias("t")))), lambda x: x["t"])
    none = F.array().cast("array<string>")
    grow = lambda fits: lambda got, t: F.when((F.size(got) < need) & ~F.exists(got, lambda g: fits(g, t)), F.concat(got, F.array(t))).otherwise(got)
    return bound(ranked, lambda r: bound(F.aggregate(r, none, grow(too_similar)), lambda first: F.aggregate(r, first, grow(lambda g, t: option_text(g) == option_text(t)))))


def clue_stem(clue: Column) -> Column:
    short = lambda c: F.when(F.length(c) > CLUE, F.concat(F.substring(c, 1, CLUE - 3), F.lit("..."))).otherwise(c)
    return bound(trimmed(F.regexp_replace(clue, r"\.\z", "")), lambda c: F.when(c == "", F.lit(NO_CLUE)).otherwise(F.concat(F.lit(STEM[0]), short(c), F.lit(STEM[1]))))


def rewritten(level: Column, domain: Column, name: Column, facts: Column, options: Column, answer: Column, quote: Column, clue: Column, distractor: Column, tempting: Column, fails: Column, pool: Column) -> Column:
    """struct of stem, options, answer, target, distractor, tempting, fails, explanation; null for a draft that stays as it is.

    pool: texts that may be distractors, the better ones first (choice_pool). Texts that are null are empty; a draft for
    which the pool is too small stays.
    """
    said = lambda c: trimmed(F.coalesce(c, F.lit("")))
    own = F.when((said(distractor) != "") & ~said(distractor).rlike(DEFINITION_DISTRACTOR), F.array(said(distractor))).otherwise(F.array().cast("array<string>"))
    at = F.when(answer.between(0, OPTIONS - 1), answer).otherwise(MIDDLE).cast("int")
    filled = lambda *cs: F.coalesce(*(F.when(c != "", c) for c in cs), F.lit(""))
    given = filled(said(clue), said(quote), F.coalesce(F.get(facts, 0), F.lit("")), name)
    bare = lambda c: F.regexp_replace(c, r"\.\z", "")

    def made(x: Column) -> Column:
        d = x["d"]
        first = d[0]
        why = F.when(said(tempting) != "", said(tempting)).otherwise(F.concat(first, F.lit(NEARBY)))
        not_it = F.when(said(fails) != "", said(fails)).when(said(clue) != "", F.concat(first, F.lit(FAILS), said(clue), F.lit("."))).otherwise(F.concat(first, F.lit(FAILS_STEM)))
        return bound(F.struct(first.alias("first"), why.alias("why"), not_it.alias("not_it"), d.alias("d"), x["at"].alias("at")), lambda y: F.struct(
            clue_stem(given).alias("stem"), F.concat(F.slice(y["d"], F.lit(1), y["at"]), F.array(name), F.slice(y["d"], y["at"] + 1, F.lit(OPTIONS))).alias("options"), y["at"].alias("answer"), F.lit("definition").alias("target"),
            y["first"].alias("distractor"), y["why"].alias("tempting"), y["not_it"].alias("fails"),
            F.concat(name, F.lit(EXPLAINED[0]), y["first"], F.lit(EXPLAINED[1]), bare(y["why"]), F.lit(EXPLAINED[2]), bare(y["not_it"]), F.lit(".")).alias("explanation"),
        ))

    choices = different(pool, name, keyed=True)
    enough = lambda c: F.size(c) >= OPTIONS - 1
    new = bound(choices, lambda p: F.when(enough(p), bound(different(F.concat(own, p), name, keyed=False), lambda c: F.when(enough(c), bound(F.struct(picked(c, name).alias("d"), at.alias("at")), made)))))
    return F.when(is_definition_soup(level, domain, options), new)


def choice_pool(candidates: Column, siblings: Column, concept: Column, domain: Column) -> Column:
    """The candidates' texts, then the names of the document's other concepts of the same domain or of a related name, important ones first. siblings: structs of id, name, domain, importance."""
    near = F.filter(siblings, lambda s: (s["id"] != concept) & (s["domain"].eqNullSafe(domain) | s["name"].rlike(RELATED_NAMES)))
    rank = lambda s: F.when(s["importance"] == "high", 0).when(s["importance"] == "medium", 1).otherwise(2)
    named = F.transform(F.array_sort(F.transform(near, lambda s, i: F.struct(rank(s).alias("r"), i.alias("i"), s["name"].alias("name")))), lambda x: x["name"])
    return F.concat(F.coalesce(candidates, F.array().cast("array<string>")), named)
