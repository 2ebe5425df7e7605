"""Rules on drafts, pages and requests: DataFrame programs from the library's Column functions, held against DuckDB queries that were written from the rules alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from studymill.functions import costs
from studymill.functions import pages as P
from studymill.functions import text as T
from studymill.functions import validation as V
from studymill.functions.text import bound
from studymill.operators import matching
from studymill.operators.ranking import checked
from studymill.sources.drafts import DRAFTS
from studymill.sources.fixtures import FIXTURES
from studymill.sources.scratch import stored

from .plan import Plan
from .relational import SQL as RELATIONAL
from .rule_oracles import SQL

FIX = DRAFTS | FIXTURES


def table(name: str):
    return Plan(f"SELECT * FROM {{{name}}}", FIX)


def over(name: str, make):
    """A query of the columns that make() gives, from a fixture."""
    return lambda spark, sf_dir: table(name)(spark, sf_dir).select(*make())


C = F.col
DRAFT = ("level", "stem", "options", "answer", "explanation", "quote", "clue", "target", "distractor", "tempting", "fails", "source")


def md5(c):
    return F.md5(c.cast("binary"))


# pages -----------------------------------------------------------------------------------------------------------------


def tagged(spark, sf_dir):
    return table("bank_pages")(spark, sf_dir).select("book", "page", P.page_kind(C("text")).alias("kind"), P.unit_of(C("text")).alias("unit"))


def sections(spark, sf_dir):
    """WIN18, AGG34: pages of questions and the answers that follow are a section; pages of neither kind are passed over. Its unit is the commonest one of its question pages, else of its answer pages, the first one of equals."""
    order = Window.partitionBy("book").orderBy("page")
    t = tagged(spark, sf_dir).where("kind <> 'empty'").withColumn("turn", ((C("kind") == "q") & (F.lag("kind").over(order) == "a")).cast("int"))
    t = t.withColumn("section", F.sum(F.coalesce("turn", F.lit(0))).over(order))
    units = t.where("unit is not null").groupBy("book", "section", "kind", "unit").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    unit = units.groupBy("book", "section").agg(F.max_by("unit", F.struct(C("kind"), C("n"), -C("first"))).alias("unit"))  # q after a
    found = t.groupBy("book", "section").agg(F.min(F.when(C("kind") == "q", C("page"))).alias("first_page"), F.count_if(C("kind") == "q").alias("q_pages"), F.count_if(C("kind") == "a").alias("a_pages"))
    return found.where("q_pages > 0 and a_pages > 0").join(unit, ["book", "section"], "left").select("book", "first_page", "q_pages", "a_pages", "unit")


def heading_rows(spark, sf_dir):
    found = table("bank_pages")(spark, sf_dir).select("id", F.posexplode(P.headed_sections(C("text"))).alias("place", "s"))
    return found.select("id", "place", "s.heading", md5(C("s.content")).alias("content"))


def paragraph_segments(spark, sf_dir):
    texts = F.filter(F.transform(F.split("text", "\n"), T.trimmed), lambda x: x != "")
    return table("bank_pages")(spark, sf_dir).select("id", F.array_join(P.packed(texts, F.lit(4)).cast("array<string>"), ",").alias("segments"))


def even_parts(spark, sf_dir):
    found = table("bank_pages")(spark, sf_dir).select("id", F.posexplode(P.even_cuts(C("text"), 3)).alias("place", "s"))
    return found.select("id", "place", "s.a", "s.b")


# joins and aggregates --------------------------------------------------------------------------------------------------


def flag_frequency(spark, sf_dir):
    """AGG19: how often each flag stands on an option set."""
    d = table("drafts")(spark, sf_dir)
    return d.select(F.explode(T.option_flags(C("options"), C("answer"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def relevance(spark, sf_dir):
    """SRT06: place of the search text in label and hint, actions 50 earlier, those without it gone."""
    p = table("pdfs")(spark, sf_dir)
    items = p.where("processed").select("id", F.lit("pdf").alias("type"), F.concat_ws(" ", F.coalesce("display_name", F.regexp_replace("name", r"(?i)\.pdf$", "")), F.concat(C("question_count").cast("string"), F.lit(" Q"))).alias("hay"))
    acts = p.where("id % 7 = 0").select("id", F.lit("action").alias("type"), F.concat(F.lit("Open chapter 1"), C("id").cast("string")).alias("hay"))
    found = items.unionByName(acts).withColumn("at", F.instr(F.lower("hay"), F.lit("1")))
    return found.where("at > 0").select("id", "type", (C("at") - 1 - F.when(C("type") == "action", 50).otherwise(0)).cast("long").alias("score"))


def exemplars(spark, sf_dir):
    """JOI21: two exemplars whose topic holds a word of the concept's name, those of level 2 first; words meet topics once, and each word needs no more than its best two."""
    concepts, exam = table("concepts")(spark, sf_dir), table("exemplars")(spark, sf_dir)
    order = [F.when(C("level") == 2, 0).otherwise(1), C("exemplar")]
    word = concepts.select("id", F.explode(F.array_distinct(T.words(F.lower("name")))).alias("word"))
    topics = exam.select("topic").distinct().withColumn("key", F.xxhash64("topic"))
    held = matching.contained(word.select("word").distinct(), topics, "word", "word", "key", "topic").join(topics, C("text_id") == C("key")).select(C("needle_id").alias("word"), "topic")
    best = held.join(exam, "topic").withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where("k <= 2").drop("k", "topic")
    met = word.join(best, "word").select("id", "exemplar", "level").distinct()
    return met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order)).cast("long")).where("place <= 2").select("id", "exemplar", "place")


def keyword_terms(spark, sf_dir):
    q = table("queries")(spark, sf_dir)
    return q.select("query_id", F.explode(F.array_distinct(F.filter(F.split(T.plain(C("text")), " "), lambda w: F.length(w) >= 4))).alias("term"))


def keyword_weights(spark, sf_dir):
    """(query_id, id, weight): a row for each term of a query that a chunk's plain text holds. Terms meet the words of the corpus once, the words their chunks, and chunks the queries as numbers of terms."""
    words = table("chunks")(spark, sf_dir).select("id", F.explode(F.array_distinct(F.split(T.plain(F.coalesce("text", F.lit(""))), " "))).alias("word"))
    terms = keyword_terms(spark, sf_dir)
    numbered = stored(terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms")
    held = matching.contained(numbered, words.select("word").distinct(), "number", "term", "word", "word").select(C("needle_id").alias("number"), C("text_id").alias("word"))
    met = words.join(checked(stored(held, "held")), "word").select("id", "number").distinct()
    asked = checked(stored(terms.join(numbered, "term").select("query_id", "number", F.greatest(F.lit(1.0), F.length("term") / 8).alias("weight")), "asked"))
    return met.join(asked, "number").select("query_id", "id", "weight")


def summed(weights):
    return weights.groupBy("query_id", "id").agg((F.floor(F.sum("weight") * 1000000 + 0.5) / 1000000).alias("score"))


def keyword_scores(spark, sf_dir):
    """MTH15: for each query and chunk the sum of max(1, length / 8) of the query's terms that the chunk's plain text holds."""
    return summed(keyword_weights(spark, sf_dir))


def relevant_chunks(spark, sf_dir):
    """ALG27: the four chunks of the highest keyword score, ties to the smaller id; chunks of score 0 fill up."""
    found = keyword_weights(spark, sf_dir)
    first = table("chunks")(spark, sf_dir).select("id").orderBy("id").limit(8)  # at least four of these, or all, are left for those with less than four scores
    fill = table("queries")(spark, sf_dir).select("query_id").join(F.broadcast(first), how="cross").distinct().withColumn("weight", F.lit(0.0))  # adds nothing where there is a score
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return summed(found.unionByName(fill)).withColumn("place", place).where("place <= 4").select("query_id", "id", C("place").cast("long"))


def line_headers(spark, sf_dir):
    """WIN03: the first three lines of up to eight words and at least four letters in capitals or title case."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.trimmed), lambda t: (F.size(T.words(t)).between(1, 8)) & (F.length(t) >= 4))
    title = lambda t: t.rlike("^[A-Z]") & F.forall(F.split(t, " "), lambda w: (F.length(w) <= 3) | w.rlike("^[A-Z]"))
    heads = F.slice(F.filter(lines, lambda t: ((t == F.upper(t)) & t.rlike("[A-Z]")) | title(t)), 1, 3)
    return table("bank_pages")(spark, sf_dir).select("id", F.array_join(heads, " ~ ").alias("headers"))


def empty_prints(spark, sf_dir):
    """QRK07: texts without any word but stop words have one fingerprint, and so are one class."""
    empty = table("chunks")(spark, sf_dir).where(T.fingerprint(F.coalesce("text", F.lit(""))) == "").select("id")
    return empty.join(F.broadcast(empty.agg(F.min("id").alias("class"))), how="cross")


def coerced_questions(spark, sf_dir):
    """JSN04: options as texts without empty ones, the answer as a number, the level from 1 to 3, whatever types a model wrote."""
    raw = table("raw_questions")(spark, sf_dir)
    read = F.from_json("json", "options array<string>, answer string, level string")
    options = F.filter(F.transform(F.coalesce(read["options"], F.array().cast("array<string>")), lambda o: T.trimmed(F.coalesce(o, F.lit("")))), lambda o: o != "")
    return raw.select("id", joined(options).alias("options"), F.coalesce(T.answer_index(read["answer"]), F.lit(0)).cast("long").alias("answer"), F.coalesce(T.question_level(read["level"]), F.lit(1)).cast("long").alias("level"))


def coupled_reviews(spark, sf_dir):
    """STM05: the reviews of each question, those that come from a sibling's answer among them."""
    from studymill.streaming.states import proxied

    got = proxied(table("answers")(spark, sf_dir))
    return got.groupBy("user_id", "question_id").agg(F.count("*").alias("reviews"), F.count_if("counts").alias("counted"))


def scheduled_states(spark, sf_dir):
    """STM04 as a batch: the state of each key after all its reviews, which the stream reaches too."""
    from studymill.operators import scheduling

    return scheduling.rounded(scheduling.fold(table("reviews")(spark, sf_dir)))


def cost_estimates(spark, sf_dir):
    """MTH09: both pipelines at each density for the page counts there are."""
    pages = table("pdfs")(spark, sf_dir).select((C("page_count") * 12).alias("pages")).distinct()
    kinds = [(d, r) for d in costs.DENSITIES for r in (False, True)]
    each = pages.select("pages", F.explode(F.array(*[F.struct(F.lit(d).alias("density"), F.lit(r).alias("rewritten"), costs.estimate(C("pages"), d, r).alias("e")) for d, r in kinds])).alias("x"))
    return each.select("pages", "x.density", "x.rewritten", "x.e.*")


def repaired_rows(spark, sf_dir):
    d = table("drafts")(spark, sf_dir)
    x = V.repaired_draft(C("quote"), C("options"), C("answer"), C("clue"), C("explanation"), C("a"), C("source"))
    return d.select("id", x.alias("x")).select("id", "x.*")


def verdicts(spark, sf_dir):
    n = len(VERDICT_ISSUES)
    texts = F.array(*[F.lit(x) for x, _ in VERDICT_ISSUES])
    at = (C("id") % n).cast("int")
    issues = F.when(C("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(texts, at), F.get(texts, F.when(C("id") % 3 == 0, at).otherwise((at * 5 + 2) % n))))
    return table("bank_pages")(spark, sf_dir).select("id", T.verdict(issues).alias("verdict"))


def distractor_pool(spark, sf_dir):
    """ALG19: for each concept up to eight candidates: peers of its category, then confusion targets (which take over a peer of their name), then concepts whose label holds an association; each label once, never the concept's own.

    A concept needs no more than its first nine peers (one may be itself), so ranked heads of a category are joined, not all pairs.
    """
    c = table("concepts")(spark, sf_dir).select("id", "pos", "name", "category", T.label(C("name")).alias("label"))
    names = c.groupBy("category", "label").agg(F.min_by(F.struct("pos", "name"), "pos").alias("x")).select("category", "label", "x.pos", "x.name")
    heads = names.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("pos"))).where("k <= 9")
    peer = c.select("id", "category", C("label").alias("own")).join(heads, "category").where("label <> own").select("id", "label", C("name").alias("text"), F.lit(1).alias("source"), C("pos").alias("rank"))
    target = table("confusions")(spark, sf_dir).select("id", T.label(C("target")).alias("label"), C("target").alias("text"), F.lit(2).alias("source"), C("n").alias("rank"))
    every = peer.unionByName(target).join(c.select("id", C("label").alias("own")), "id").where("label <> '' and label <> own")
    one = every.groupBy("id", "label").agg(F.min(F.struct("source", "rank", "text")).alias("x"), F.max("source").alias("most"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("x.source", "x.rank", "label"))
    out = one.withColumn("place", place.cast("long")).where("place <= 8")
    return out.select("id", "place", "x.text", F.when(C("most") == 2, "confusion_pair").otherwise("same_category_peer").alias("reason"))


def key_sweep(spark, sf_dir):
    """ALG28: questions whose explanation speaks for another option: the reason is appended once, and a flag row is added where none is there."""
    d = table("drafts")(spark, sf_dir).select("id", V.mismatch_issue(C("options"), C("answer"), F.coalesce("explanation", F.lit(""))).alias("mismatch"))
    d = stored(d, "mismatches").where("mismatch is not null")  # a condition on it would be evaluated once more at the scan, with all that it is made of put in at each use
    before = F.when(C("id") % 3 == 0, "ANSWER_KEY_MISMATCH | other").when(C("id") % 3 == 1, "other")
    known = table("drafts")(spark, sf_dir).where("id % 4 = 0").select("id", F.lit(True).alias("known"))
    after = F.when(F.contains(before, F.lit("ANSWER_KEY_MISMATCH")), before).otherwise(F.concat_ws(" | ", before, F.lit("ANSWER_KEY_MISMATCH")))
    return d.join(known, "id", "left").select("id", "mismatch", after.alias("flag_reason"), C("known").isNull().alias("new_row"))


def provenance(spark, sf_dir):
    """ALG07: for each quote the first chunk that holds it as it is, with its place."""
    q = stored(table("drafts")(spark, sf_dir).select("id", "quote"), "quotes").where("quote is not null and length(trim(quote)) > 0").select("id", T.trimmed(C("quote")).alias("target"))  # stored, as in key_sweep
    chunks = table("chunks")(spark, sf_dir).where("text is not null").select(C("id").alias("chunk"), "text")
    held = matching.contained(q.select("target").distinct(), chunks, "target", "target", "chunk", "text")
    where = held.groupBy(C("needle_id").alias("target")).agg(F.min("text_id").alias("chunk")).join(chunks, "chunk").select("target", "chunk", F.instr("text", C("target")).alias("at"))  # texts stay behind
    met = q.join(where, "target")
    first = met.groupBy("id").agg(F.min_by(F.struct("chunk", "at", F.length("target").alias("n")), "chunk").alias("x"))
    return first.select("id", C("x.chunk").alias("chunk"), (C("x.at") - 1).cast("long").alias("start"), (C("x.at") - 1 + C("x.n")).cast("long").alias("end"))


def restored_orders(spark, sf_dir):
    """JOI24: a saved order gives a session's items back only if it names each of them once."""
    saved, items = table("saved_orders")(spark, sf_dir), table("session_items")(spark, sf_dir)
    n = items.groupBy("session").agg(F.count("*").alias("n"))
    sound = saved.join(n, "session").where((F.size("ids") == C("n")) & (F.size(F.array_distinct("ids")) == C("n")))
    each = sound.select("session", F.posexplode("ids").alias("place", "id")).join(items, ["session", "id"], "left_semi")
    whole = each.groupBy("session").agg(F.count("*").alias("found")).join(n, "session").where("found = n").select("session")
    return each.join(whole, "session").select("session", F.col("place").cast("long").alias("place"), "id")


def framed_events(spark, sf_dir):
    """SRC09: blocks parted by blank lines; the data lines of a block joined and read as JSON; unreadable blocks are passed over."""
    t = table("framed")(spark, sf_dir)
    blocks = t.select("job_id", F.posexplode(F.split("body", "\r?\n\r?\n")).alias("place", "block"))
    data = F.transform(F.filter(F.transform(F.split("block", "\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), r"^\s+", ""))
    read = F.from_json(F.trim(F.array_join(data, "\n")), "phase int, message string, pct int")
    return blocks.select("job_id", C("place").cast("long").alias("place"), read.alias("e")).where("e.phase is not null").select("job_id", "place", "e.phase", "e.message", "e.pct")


def until_terminal(spark, sf_dir):
    """STM02: of each job's events those up to the first terminal one (phase 7, or the message done)."""
    e = framed_events(spark, sf_dir).withColumn("last", ((C("phase") == 7) | (F.lower(F.trim("message")) == "done")).cast("int"))
    before = F.sum("last").over(Window.partitionBy("job_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("before", F.coalesce(before, F.lit(0))).where("before = 0").groupBy("job_id").agg(F.count("*").alias("events"), F.max_by("phase", "place").alias("phase"), F.max_by("message", "place").alias("message"))


def plan_gate(spark, sf_dir):
    """ALG30: whether a user may add a document this month: the counter is 0 again once the month has changed (DAT03), and no limit is no bound."""
    u = table("profiles")(spark, sf_dir)
    month = lambda c: F.year(c) * 12 + F.month(c)
    used = F.when(month(F.lit("2024-01-08").cast("date")) > month(C("reset_day")), 0).otherwise(C("used"))
    tier = F.when(C("plan").isin("student", "boards", "institution"), C("plan")).otherwise("free")
    limit = F.when(tier == "free", 2).when(tier == "student", 10).when(tier == "boards", 30)
    return u.select("user_id", tier.alias("tier"), used.cast("long").alias("used"), F.coalesce(used < limit, F.lit(True)).alias("allowed"))


def month_reset(spark, sf_dir):
    """DAT03."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    u = table("profiles")(spark, sf_dir)
    return u.select("user_id", (month(F.lit("2024-01-08").cast("date")) > month(C("reset_day"))).alias("reset"))


def joined_peers(spark, sf_dir):
    """SET05 with QRK06: words of the left text, as often as they stand there, that the right one holds."""
    return table("option_texts")(spark, sf_dir).select("id", F.size(F.filter(T.words(F.lower("a")), lambda w: F.array_contains(T.words(F.lower(C("b"))), w))).cast("long").alias("shared"))


def taken_slugs(spark, sf_dir):
    """STR18: the slug itself, or the first of its forms -2 to -20 that no bank has; null beyond."""
    b = table("slug_requests")(spark, sf_dir)
    forms = b.select("id", "base", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).withColumn("slug", F.when(C("k") == 1, C("base")).otherwise(F.concat_ws("-", "base", C("k").cast("string"))))
    free = forms.join(table("slugs_there")(spark, sf_dir), "slug", "left_anti").groupBy("id").agg(F.min_by("slug", "k").alias("slug"))
    return b.join(free, "id", "left").select("id", "slug")


FIX |= {
    "exemplars": "SELECT p_partkey AS exemplar, CAST(p_partkey % 3 AS INT) + 1 AS level, lower(p_type) AS topic FROM {part} UNION ALL SELECT p_partkey + 10000000, CAST(p_partkey % 2 AS INT) + 1, lower(concat(p_name, ' of ', p_brand)) FROM {part} WHERE p_partkey % 5 = 0",
    "confusions": "SELECT p_partkey AS id, n, concat(p_type, ' kind ', CAST(n AS STRING)) AS target FROM {part} CROSS JOIN (SELECT r_regionkey AS n FROM {region} WHERE r_regionkey < 2) AS r WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 5, p_name FROM {part} WHERE p_partkey % 4 = 0 UNION ALL SELECT a.p_partkey, 6, upper(b.p_name) FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 AND b.p_type = a.p_type",
    "session_items": "SELECT o_custkey AS session, o_orderkey AS id FROM {orders} WHERE o_custkey % 3 <> 0",
    "saved_orders": "SELECT o_custkey AS session, CASE o_custkey % 4 WHEN 0 THEN PUT(ids, CAST(-1 AS BIGINT)) WHEN 1 THEN ids WHEN 2 THEN HEAD(ids, 3) ELSE PUT(HEAD(ids, SIZE(ids) - 1), CAST(-5 AS BIGINT)) END AS ids FROM (SELECT o_custkey, GATHERED(o_orderkey, o_totalprice, o_orderkey) AS ids FROM {orders} GROUP BY o_custkey) AS x",
    "framed": "SELECT conv_id AS job_id, concat(LINES(concat('event: x', chr(10), 'data: ', chr(123), '\"phase\": ', CAST(least(7, turn) AS STRING), ', \"message\": \"', CASE WHEN turn % 5 = 4 THEN ' Done ' ELSE role END, '\",', chr(10), 'data:  \"pct\": ', CAST(turn * 15 AS STRING), chr(125), CASE WHEN turn % 4 = 2 THEN concat(chr(10), chr(10), ': heartbeat', chr(10), chr(10), 'data: ', chr(123), 'broken') ELSE '' END), turn), chr(10)) AS body FROM {conversations} GROUP BY conv_id",
    "profiles": "SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'student' WHEN 1 THEN 'boards' WHEN 2 THEN 'institution' WHEN 3 THEN 'gold' END AS plan, c_custkey % 13 AS used, CAST(DATE '2024-01-20' - CAST(c_custkey % 40 AS INT) AS DATE) AS reset_day FROM {customer}",
    "option_texts": "SELECT p_partkey AS id, concat(p_name, ' ', p_type, ' ', p_name) AS a, concat(p_type, ' ', p_brand, ' ', p_name) AS b FROM {part}",
    "slug_requests": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'heart-bank' WHEN s_suppkey % 3 = 1 THEN 'full' ELSE concat('own-', CAST(s_suppkey AS STRING)) END AS base FROM {supplier}",
    "slugs_there": "SELECT 'heart-bank' AS slug FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT concat('heart-bank-', CAST(r_regionkey + 2 AS STRING)) FROM {region} WHERE r_regionkey < 3 UNION ALL SELECT 'full' FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT concat('full-', CAST(n_nationkey + 2 AS STRING)) FROM {nation}",
}

joined = lambda c: F.array_join(c, " ~ ")


def issue_rows(spark, sf_dir):
    d = table("drafts")(spark, sf_dir)
    return d.select("id", V.question_issues(*(C(c) for c in DRAFT)).alias("v")).select("id", joined(C("v.issues")).alias("issues"), F.array_join("v.flags", ",").alias("flags"), "v.evidence_ok", T.verdict(C("v.issues")).alias("verdict"))


def draft_rows(spark, sf_dir):
    d = table("drafts")(spark, sf_dir)
    slot_level = F.when(C("id") % 7 == 0, C("level") % 3 + 1).otherwise(C("level"))
    concept = F.when(C("id") % 5 == 0, "").when(C("id") % 5 == 1, "c2").otherwise("c1")
    name = F.when(C("id") % 4 == 0, "Heart (failure)").when(C("id") % 4 == 1, "heart  failure").otherwise("Stroke")
    return d.select("id", V.draft_faults(C("level"), slot_level, C("stem"), C("options"), C("answer"), concept, F.lit("c1"), name, F.lit("heart failure")).alias("v")).select("id", joined(C("v.issues")).alias("issues"), "v.retry", "v.checked")


RAW_ANSWER = lambda: F.when(C("id") % 5 == 0, "B").when(C("id") % 5 == 1, C("answer").cast("string")).when(C("id") % 5 == 2, " 9 ").when(C("id") % 5 == 3, "x").otherwise("d")


def mapped_rows(spark, sf_dir):
    d = table("drafts")(spark, sf_dir).withColumn("raw", T.answer_index(RAW_ANSWER()).cast("int"))
    reason = V.flag_reason(C("stem"), C("options"), C("raw"), C("explanation"), C("quote"), C("source"))
    return d.select("id", reason.alias("flag_reason"), (F.coalesce(reason, F.lit("")) == "SOURCE_STEM_COPY").alias("discarded"))


QUERIES = {
    "str36_page_kinds": lambda spark, sf_dir: tagged(spark, sf_dir).select("book", "page", "kind"),
    "str37_units": lambda spark, sf_dir: tagged(spark, sf_dir).select("book", "page", "unit"),
    "win18_sections": sections,
    "agg35_max_number": over("bank_pages", lambda: ["id", P.last_answer(C("text")).alias("last_answer")]),
    "win21_ranges": over("bank_pages", lambda: ["id", md5(P.lines_of_range(C("text"), 2, 12)).alias("lines")]),
    "win15_headings": heading_rows,
    "win16_packing": paragraph_segments,
    "win17_even_split": even_parts,
    "fil15_front_matter": over("bank_pages", lambda: ["id", ((F.length(F.trim("text")) >= 80) & ~P.is_front_matter(C("text"))).alias("eligible")]),
    "agg19_flag_frequency": flag_frequency,
    "srt06_relevance": relevance,
    "joi21_exemplars": exemplars,
    "alg19_distractor_pool": distractor_pool,
    "alg28_key_sweep": key_sweep,
    "alg07_provenance": provenance,
    "joi24_saved_orders": restored_orders,
    "src09_event_blocks": framed_events,
    "stm02_until_terminal": until_terminal,
    "alg30_plan_gate": plan_gate,
    "dat03_month_reset": month_reset,
    "set05_shared_tokens": joined_peers,
    "str18_free_slugs": taken_slugs,
    "str01_stem_tokens": over("chunks", lambda: ["id", F.size(T.stem_tokens(C("text"))).cast("long").alias("n"), F.get(T.stem_tokens(C("text")), 0).alias("first_token")]),
    "str02_fingerprints": over("chunks", lambda: ["id", T.fingerprint(C("text")).alias("fingerprint")]),
    "str05_evidence_texts": over("drafts", lambda: ["id", md5(T.evidence_text(F.concat_ws(" ", "quote", "source"))).alias("evidence_text")]),
    "str06_search_texts": over("drafts", lambda: ["id", md5(T.search_text(F.concat_ws(" ", "quote", "source"))).alias("search_text")]),
    "str07_copy_texts": over("drafts", lambda: ["id", md5(T.copy_text(F.concat_ws(" ", "a", F.lit("- wrapped"), "source"))).alias("copy_text")]),
    "str12_option_aliases": over("drafts", lambda: ["id", joined(F.array_sort(F.flatten(F.transform("options", T.option_aliases)))).alias("aliases")]),
    "str13_concept_aliases": over("drafts", lambda: ["id", joined(F.array_sort(V.concept_aliases(F.concat(C("a"), F.lit(" ("), C("b"), F.lit(") losses")), F.array("s0", F.lit("Two (2) facts"))))).alias("aliases")]),
    "str19_sentences": over("drafts", lambda: ["id", F.size(V.evidence_sentences(C("source"))).cast("long").alias("n"), md5(joined(V.evidence_sentences(C("source")))).alias("sentences")]),
    "str20_embedded": over("drafts", lambda: ["id", T.is_embedded_mcq(C("stem")).alias("stem"), T.is_embedded_mcq(F.concat(F.when(C("id") % 3 == 0, "A Endothelial disruption B ").otherwise("It "), "s0")).alias("listed")]),
    "str22_without_tail": over("drafts", lambda: ["id", V.without_tail(F.element_at("options", -2)).alias("option"), V.without_tail(F.concat("a", F.lit(", which rises "), "b")).alias("clause")]),
    "str23_interrogative": over("drafts", lambda: ["id", T.is_interrogative(C("stem")).alias("interrogative")]),
    "str24_negation": over("drafts", lambda: ["id", T.is_negation(C("stem")).alias("negation"), T.opens_with_case(C("stem")).alias("opens_with_case")]),
    "str25_quote_faults": over("drafts", lambda: ["id", V.quote_issue(F.coalesce("quote", F.lit(""))).alias("issue")]),
    "str26_canonical_issues": over("drafts", lambda: ["id", V.canonical_issue(F.concat_ws(" ", F.element_at(F.array(*map(F.lit, CANONICAL)), (C("id") % len(CANONICAL)).cast("int") + 1), "a")).alias("form")]),
    "str27_unique_issues": over("drafts", lambda: ["id", joined(V.unique_issues(F.array(*[F.concat(F.lit(x), F.element_at(F.array("a", "b", F.lit("")), (C("id") % 3).cast("int") + 1)) for x in [*CANONICAL, *CANONICAL, " ", "Nine!", "nine", "ten", "eleven", "twelve", "13"]]))).alias("issues")]),
    "str28_domains": over("domain_concepts", lambda: ["id", T.coverage_domain(C("name"), C("category")).alias("domain")]),
    "str29_anchor_support": over("drafts", lambda: ["id", T.anchor_support(C("clue"), C("s0")).alias("supported")]),
    "str32_overlap": over("option_texts", lambda: ["id", (F.floor(T.overlap_share(T.words(T.label(C("a"))), T.words(T.label(C("b"))), F.greatest) * 1000000 + 0.5) / 1000000).alias("overlap")]),
    "str33_similar_options": over("drafts", lambda: ["id", V.too_similar(F.get("options", 0), F.get("options", 1)).alias("first_two"), V.too_similar(F.concat(F.lit("a) "), "a", F.lit(" disease")), F.concat("b", F.lit(" "), "a")).alias("made")]),
    "str34_explanations": over("drafts", lambda: ["id", V.simple_explanation(F.concat_ws(" ", F.when(C("id") % 3 == 0, C("a")).when(C("id") % 3 == 1, F.concat("b", F.lit(" "), "a", F.lit("."))), F.lit(": It is so. And more")), C("a")).alias("simple")]),
    "str40_clinical_support": over("bank_pages", lambda: ["id", V.clinical_support(F.concat_ws(" ", "text", F.when(C("id") % 3 == 0, "a patient with fever and pain"))).alias("supported")]),
    "str41_feature_texts": over("domain_concepts", lambda: ["id", V.shared_feature(C("category"), C("domain"), C("name")).alias("shared"), V.differentiator(C("category"), C("domain"), F.lit("X"), C("name"), F.when(C("id") % 5 == 0, "given")).alias("differs")]),
    "mth12_length_tells": over("drafts", lambda: ["id", V.length_tell(C("options"), C("answer")).alias("tells"), V.repaired_tell(C("options"), C("answer")).alias("repaired")]),
    "mth17_definition_scores": over("drafts", lambda: ["id", V.definition_score(F.get("options", 0), F.get("options", 1)).cast("long").alias("score"), V.definition_score(F.concat("a", F.lit("/"), "b", F.lit(" (x) one two three")), C("s0")).cast("long").alias("made")]),
    "win06_copied_stems": over("drafts", lambda: ["id", T.is_copied_stem(C("stem"), C("source")).alias("copied")]),
    "win07_clue_spans": over("drafts", lambda: ["id", V.clue_span(F.concat_ws(" ", F.lit("odd"), "clue", "s0"), C("s0")).alias("span")]),
    "alg06_offsets": lambda spark, sf_dir: table("drafts")(spark, sf_dir).select("id", V.evidence_offsets(C("quote"), C("source")).alias("o")).select("id", "o.start", "o.end"),
    "alg12_question_issues": issue_rows,
    "alg13_draft_faults": draft_rows,
    "alg15_key_mismatches": over("drafts", lambda: ["id", T.key_mismatch(C("options"), C("answer"), F.coalesce("explanation", F.lit(""))).alias("other")]),
    "alg16_concept_mismatches": over("drafts", lambda: ["id", V.concept_mismatch(C("stem"), F.coalesce(F.get("options", C("answer")), F.lit("")), F.concat("a", F.lit(" "), "b"), F.array(F.lit("one (renin)"))).alias("mismatch")]),
    "alg17_inferred_answers": over("drafts", lambda: ["id", V.inferred_answer(C("options"), C("answer"), F.coalesce("explanation", F.lit(""))).cast("long").alias("answer")]),
    "alg26_flag_reasons": mapped_rows,
    "fil14_discarded": lambda spark, sf_dir: stored(mapped_rows(spark, sf_dir), "reasons").where("not discarded").select("id", "flag_reason"),  # stored, as in key_sweep
    "fil17_slugs": over("paths", lambda: ["id", F.when(T.trimmed(C("slug")).rlike("(?i)^[a-z0-9][a-z0-9-]{0,95}$"), T.trimmed(C("slug"))).alias("slug"), F.when(C("path").rlike(r"^/(app|s/(?i:[a-z0-9][a-z0-9-]{0,95}))([?#].*)?$"), C("path")).otherwise("/app").alias("path")]),
    "fil18_template_stems": over("drafts", lambda: ["id", C("stem").rlike("""(?i)^In the source passage, which named concept is described by ["']""").alias("template")]),
    "str38_clues": over("drafts", lambda: ["id", F.coalesce(F.nullif(F.regexp_extract("stem", f"""(?i)described by ["'](.+?)["'](?:{T.S}|[?])*$""", 1), F.lit("")), "stem").alias("clue")]),
    "fil20_fact_check": over("drafts", lambda: ["id", ((C("id") % 4 != 0) & (F.size(T.option_flags(C("options"), C("answer"))) == 0)).alias("accurate"), ((F.trim(F.concat_ws(" ", F.nullif("quote", F.lit("")), F.when(C("id") % 3 == 0, "chunk"))) != "") & (F.coalesce("quote", F.lit("")) != "UNGROUNDED")).alias("sourced")]),
    "mth15_keyword_score": keyword_scores,
    "alg27_relevant_chunks": relevant_chunks,
    "win03_headers": line_headers,
    "qrk07_empty_fingerprints": empty_prints,
    "jsn04_coerced_questions": coerced_questions,
    "stm04_scheduled_states": scheduled_states,
    "stm05_coupled_reviews": coupled_reviews,
    "alg14_verdicts": verdicts,
    "mth09_cost_estimates": cost_estimates,
    "alg18_repaired_drafts": repaired_rows,
    "str43_sentence_scores": over("drafts", lambda: ["id", V.sentence_score(C("s0"), F.array("a", F.concat("a", F.lit(" "), "b"), F.lit("zz yy"))).alias("score"), md5(F.coalesce(V.better_sentence(C("source"), C("quote"), F.array("a", "b")), F.lit(""))).alias("better")]),
    "win04_fuzzy_ratios": over("drafts", lambda: ["id", (F.floor(T.fuzzy_ratio(F.regexp_replace("s0", " ", " indeed "), F.concat_ws(" ", F.lit("Before it"), "s0", "quote", "s0")) * 1000000 + 0.5) / 1000000).alias("plain"), (F.floor(T.fuzzy_ratio(C("s0"), F.concat_ws(" ", F.lit("Before it"), "quote", "s0")) * 1000000 + 0.5) / 1000000).alias("ratio")]),
    "str30_clause_matches": over("drafts", lambda: ["id", T.clause_match(F.concat(C("s0"), F.lit("; "), F.when(C("id") % 3 == 0, "an invented clause").otherwise(F.lit("short")), F.lit("• "), F.when(C("id") % 2 == 0, C("s0")).otherwise(F.lit("x, y and some more"))), C("source")).alias("confidence")]),
    "fil16_request_faults": over("attempt_requests", lambda: ["id", F.when(F.coalesce("question", F.lit("")) == "", "questionId is required").when(C("option").isNull() | (C("option") < -1) | (C("option") != F.floor("option")), "selectedOption must be an integer >= -1").when(C("correct").isNull(), "isCorrect must be a boolean").when(C("ms").isNull() | (C("ms") < 0) | (C("ms") != F.floor("ms")), "timeSpentMs must be a non-negative integer").when(C("reason").isNotNull() & ~C("reason").isin("wrong_answer", "ambiguous", "off_topic", "other"), "Invalid flagReason").alias("fault")]),
}

#: Issue texts, and the group of rules that each belongs to.
VERDICT_ISSUES = [
    ("Question is missing a grounded source quote from the PDF.", "EVIDENCE_GROUNDING"),
    ("Deciding clue is not clearly supported by the quoted PDF evidence.", "EVIDENCE_GROUNDING"),
    (V.FLAG_ISSUES["LENGTH_OUTLIER"], "OPTION_SET_HOMOGENEITY"),
    (V.FLAG_ISSUES["MIXED_CATEGORY"], "OPTION_SET_HOMOGENEITY"),
    (V.OVERLAP_ISSUE, "OPTION_SET_HOMOGENEITY"),
    ("Question is missing the required whyTempting rationale.", "CLINICAL_PEDAGOGY"),
    ("Explanation is too short to teach.", "CLINICAL_PEDAGOGY"),
    ("Level 1 questions should avoid negation stems such as NOT/EXCEPT/LEAST.", "STEM_LEVEL_FIDELITY"),
    ("Level 3 questions must open with an age, sex, and presentation vignette.", "STEM_LEVEL_FIDELITY"),
    ("Stem is not phrased as a question.", "DETERMINISTIC_VALIDATION"),
    ("Something else.", "DETERMINISTIC_VALIDATION"),
]

# Issue texts of each canonical form.
CANONICAL = ["The key distinction is missing", "Explanation does not name a distractor", "Source quote could not be verified", "Correct answer is not clearly supported", "Explanation fits a different answer choice", "A fabricated distractor", "Something else, entirely"]

FIX |= {
    "raw_questions": "SELECT event_id AS id, concat(chr(123), '\"options\": [\"', event_type, ' a\", ', CAST(event_id AS STRING), ', true, null, \" \", \" b \"], \"answer\": ', CASE event_id % 5 WHEN 0 THEN '\"B\"' WHEN 1 THEN '3' WHEN 2 THEN '\" 2 \"' WHEN 3 THEN 'null' ELSE '\"zz\"' END, ', \"level\": ', CASE event_id % 4 WHEN 0 THEN '2' WHEN 1 THEN '\"L3\"' WHEN 2 THEN '\"x\"' ELSE 'null' END, chr(125)) AS json FROM {events}",
    "answers": "SELECT user_id, question_id, CASE WHEN id % 4 = 0 THEN question_id - question_id % 100 + (question_id + 20) % 100 END AS proxied_from_id, quality, reviewed_at, id FROM {reviews}",
    "domain_concepts": "SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' pathway' WHEN 1 THEN ' Pressure' WHEN 2 THEN ' vs odd' WHEN 3 THEN ' therapy' WHEN 4 THEN ' starling' ELSE '' END) AS name, CASE p_partkey % 7 WHEN 0 THEN 'Drug class' WHEN 1 THEN 'Classic association' WHEN 2 THEN 'Mechanism' WHEN 3 THEN 'Condition' ELSE p_type END AS category, CASE p_partkey % 11 WHEN 0 THEN 'mechanism_causal' ELSE 'entity_recall' END AS domain FROM {part}",
    "paths": "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN concat(' ', c_name, ' ') WHEN 1 THEN lower(replace(c_name, '#', '-')) WHEN 2 THEN '' WHEN 3 THEN concat(lower(replace(c_name, '#', '-')), REPEATED('x', 90)) WHEN 4 THEN 'A-1' END AS slug, CASE c_custkey % 7 WHEN 0 THEN '/app' WHEN 1 THEN '//evil' WHEN 2 THEN concat('/s/Bank-', CAST(c_custkey AS STRING), '?a=1') WHEN 3 THEN '/app/x' WHEN 4 THEN '/app#top' WHEN 5 THEN 'app' END AS path FROM {customer}",
    "attempt_requests": "SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'q' END AS question, CASE event_id % 8 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN -2.0e0 WHEN 2 THEN 1.5e0 ELSE CAST(event_id % 5 AS DOUBLE) - 1 END AS option, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 2 = 0 END AS correct, CASE event_id % 7 WHEN 0 THEN -1.0e0 WHEN 1 THEN 0.5e0 ELSE CAST(event_id AS DOUBLE) END AS ms, CASE event_id % 4 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'none' END AS reason FROM {events}",
}


def candidate_pairs(spark, sf_dir):
    """JOI13 over all chunks as one bank."""
    from studymill.operators import dedup

    return dedup.candidate_pairs(table("chunks")(spark, sf_dir).select(F.lit(0).alias("bank"), "id", C("text").alias("stem"))).select("i", "j", C("exact").cast("int").alias("same_fingerprint"), "shared")


QUERIES["joi13_candidate_pairs"] = candidate_pairs
ORACLE = {name: Plan(sql, FIX).duckdb() for name, sql in SQL.items()} | {"stm04_scheduled_states": Plan(RELATIONAL["alg08_sm2_fold"], FIX).duckdb()}
