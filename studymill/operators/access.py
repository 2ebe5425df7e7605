"""Who sees which documents: owners, members of banks that share a document, and members of banks that share a deck with all below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studymill.sources.scratch import stored

from .ranking import checked

#: Ids of a pack, about: documents of one deck that meet a user together (fixed value).
PACK = 512
#: Packs that are broadcast; more are joined by shuffle.
BROADCAST_PACKS = 4096
OWNED, PDF_SHARE, DECK_SHARE = "1 owned", "2 pdf share", "3 deck share"


class Access:
    """few: (user_id, id, kind), each pair once with its least kind; reach: (user_id, deck, pack, taken), packs: (deck, pack, ids): the ids of a reached pack, without those taken, are the user's further ones, all of them of kind DECK_SHARE.

    A user's documents below shared decks are their number times that of the decks' documents, whereas users and decks are
    few. So users meet decks once, and a deck's documents travel as packs until they are expanded: the pairs themselves are
    neither shuffled nor compared. What is known of single pairs (own documents, shared ones, ids that several rows of
    pdfs have) stays in few and is taken out of the packs.
    """

    def __init__(self, pdfs: DataFrame, banks: DataFrame, members: DataFrame, closure: DataFrame):
        shares = banks.where("is_active").select(F.col("id").alias("bank"), "source_pdf_id", "source_deck_id").join(members, F.col("bank") == F.col("shared_bank_id"))
        shares = stored(shares.select("user_id", "source_pdf_id", "source_deck_id").distinct(), "shares")
        below = closure.select(F.col("id").alias("deck"), "ancestor")
        decks = shares.where("source_deck_id is not null").select("user_id", F.col("source_deck_id").alias("ancestor")).distinct().join(below, "ancestor").select("user_id", "deck").distinct()
        found = pdfs.groupBy("id").agg(F.count("*").alias("rows"), F.min("deck_id").alias("deck"), F.min("user_id").alias("owner"))
        single = stored(found.where("rows = 1 and id is not null and deck is not null and owner is not null").select("id", "deck"), "single")
        packs = single.groupBy("deck").agg(F.ceil(F.count("*") / PACK).alias("n"))
        placed = single.join(packs, "deck").select("deck", F.pmod(F.xxhash64("id"), "n").alias("pack"), "id")
        self.packs = stored(placed.groupBy("deck", "pack").agg(F.sort_array(F.collect_list("id")).alias("ids")), "packs")

        rest = pdfs.where("deck_id is not null").select("id", F.col("deck_id").alias("deck")).join(single.select("id"), "id", "left_anti")
        kinds = pdfs.select("user_id", "id", F.lit(OWNED).alias("kind"))
        kinds = kinds.unionByName(shares.where("source_pdf_id is not null").select("user_id", F.col("source_pdf_id").alias("id"), F.lit(PDF_SHARE).alias("kind")))
        kinds = kinds.unionByName(decks.join(rest, "deck").select("user_id", "id", F.lit(DECK_SHARE).alias("kind")))
        self.few = stored(kinds.groupBy("user_id", "id").agg(F.min("kind").alias("kind")), "few")

        taken = self.few.join(placed, "id").groupBy(F.col("user_id").alias("by"), F.col("deck").alias("of"), F.col("pack").alias("at")).agg(F.collect_list("id").alias("taken"))
        each = decks.join(self.packs.select("deck", "pack"), "deck")
        self.reach = stored(each.join(taken, F.col("user_id").eqNullSafe(F.col("by")) & (F.col("deck") == F.col("of")) & (F.col("pack") == F.col("at")), "left").select("user_id", "deck", "pack", "taken"), "reach")

    def further(self, reach: DataFrame | None = None) -> DataFrame:
        """reach, or rows made of it, each for every id of its pack that isn't taken."""
        reach = self.reach if reach is None else reach
        n = max(4 * reach.sparkSession.sparkContext.defaultParallelism, reach.count() // 40_000 + 1)
        dealt = reach.repartition(n, "deck", "pack").sortWithinPartitions("deck", "pack", "user_id")
        met = dealt.join(checked(self.packs, BROADCAST_PACKS), ["deck", "pack"])
        ids = F.when(F.col("taken").isNull(), F.col("ids")).otherwise(F.array_except("ids", "taken"))
        return met.select(*[c for c in reach.columns if c not in ("deck", "pack", "taken")], F.explode(ids).alias("id"))


def previews(pdfs: DataFrame, banks: DataFrame, members: DataFrame, closure: DataFrame) -> DataFrame:
    """AGG30: (id, questions, pages, sources, members) of each bank.

    A deck's documents are summed once for each of its ancestors and not for each bank that shares it; only banks of several
    sources, where one may hold the other, look at single documents.
    """
    sums = ["questions", "pages", "sources"]
    adds = [F.sum(c).alias(c) for c in sums]
    each = pdfs.where("id is not null").groupBy(F.col("id").alias("pdf")).agg(F.sum("question_count").alias("questions"), F.sum("page_count").alias("pages"), F.count("*").alias("sources"))
    under = pdfs.select(F.col("id").alias("pdf"), F.col("deck_id").alias("deck")).join(closure.select(F.col("id").alias("deck"), "ancestor"), "deck").select("ancestor", "pdf").distinct()
    decks = under.join(each, "pdf").groupBy("ancestor").agg(*adds)
    kinds = stored(banks.groupBy("id").agg(F.count("*").alias("rows"), F.count_distinct("source_deck_id").alias("decks"), F.count("source_pdf_id").alias("pdfs"), F.min("source_deck_id").alias("deck")), "kinds")
    whole = kinds.where("decks = 1 and pdfs = 0").select(F.col("id").alias("bank"), F.col("deck").alias("ancestor")).join(decks, "ancestor").select("bank", *sums)
    other = banks.join(kinds.where("decks <> 1 or pdfs <> 0").select("id"), "id", "left_semi")
    pairs = other.where("source_pdf_id is not null").select(F.col("id").alias("bank"), F.col("source_pdf_id").alias("pdf"))
    pairs = pairs.unionByName(other.select(F.col("id").alias("bank"), F.col("source_deck_id").alias("ancestor")).join(under, "ancestor").select("bank", "pdf")).distinct()
    found = whole.unionByName(pairs.join(each, "pdf").groupBy("bank").agg(*adds))
    n = members.groupBy("shared_bank_id").agg(F.count("*").alias("members"))
    met = kinds.join(found, F.col("id") == F.col("bank"), "left").join(n, F.col("id") == F.col("shared_bank_id"), "left")
    return met.select("id", *((F.coalesce(c, F.lit(0)) * F.col("rows")).alias(c) for c in sums), F.coalesce("members", F.lit(0)).alias("members"))
