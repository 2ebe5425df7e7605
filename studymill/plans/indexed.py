"""Queries whose Spark form is a program of an index, a distributed order or a mergeable aggregate. Where an operator's shared SQL exists, it stays the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studymill.operators import access, matching, packs, ranking, retrieval
from studymill.sources.drafts import DRAFTS
from studymill.sources.fixtures import FIXTURES
from studymill.sources.scratch import stored

from .more import FIXTURES as MORE
from .plan import Plan

FIX = DRAFTS | FIXTURES
C = F.col


def table(name: str):
    return Plan(f"SELECT * FROM {{{name}}}", FIX)


# held strings ----------------------------------------------------------------------------------------------------------


def name_containment(spark, sf_dir):
    """JOI16: pairs of concepts of one category of which one name holds the other. Different names meet once, and their concepts by equi-joins."""
    c = table("concepts")(spark, sf_dir).select("id", "category", "name")
    names = c.select("category", "name").distinct().withColumn("key", F.xxhash64("category", "name"))
    held = matching.contained(names.where(F.length("name") >= 4), names, "key", "name", "key", "name", by="category")
    both = held.unionByName(held.select(C("text_id").alias("needle_id"), C("needle_id").alias("text_id"))).distinct()
    keyed = c.withColumn("key", F.xxhash64("category", "name"))
    asks = keyed.select(C("id").alias("i"), C("key").alias("needle_id")).join(both, "needle_id").select("i", C("text_id").alias("key"))
    return packs.paired(asks, packs.packed(keyed, "key", "id"), "key", "j", C("i") < C("j"))


def association_peers(spark, sf_dir):
    """JOI18: concepts whose name holds another's association. Associations meet different names once; the concepts of a name travel as packs until they are expanded."""
    c = table("concepts")(spark, sf_dir).select("id", "name", F.get(F.filter(F.split("name", " "), lambda w: w != ""), 1).alias("association"))
    asks = c.where("association is not null").select("association").distinct()
    asks = asks.select("association", F.lower("association").alias("needle"), F.xxhash64("association").alias("ask"))
    names = c.select("name").distinct().select("name", F.lower("name").alias("text"), F.xxhash64("name").alias("key"))
    held = matching.contained(asks, names, "ask", "needle", "key", "text")
    found = held.join(asks.select("ask", "association"), held["needle_id"] == C("ask")).join(names.select("key", "name"), held["text_id"] == C("key")).select("association", "name")
    asks = c.select("id", "association").join(found, "association").select("id", "name")
    return packs.paired(asks, packs.packed(c, "name", "id"), "name", "peer", C("id") != C("peer"))


# access ----------------------------------------------------------------------------------------------------------------


def seen(spark, sf_dir) -> access.Access:
    return access.Access(*(table(n)(spark, sf_dir) for n in ("pdfs", "shared_banks", "members", "closure")))


def seen_kinds(spark, sf_dir):
    """JOI09."""
    a = seen(spark, sf_dir)
    return a.few.unionByName(a.further().withColumn("kind", F.lit(access.DECK_SHARE)))


def grants(spark, sf_dir):
    """JOI10."""
    a = seen(spark, sf_dir)
    return a.few.select("user_id", "id").unionByName(a.further()).select(C("id").alias("pdf_id"), "user_id")


def owned_shared(spark, sf_dir):
    """PRJ05. What a pack adds is no document of the user's own."""
    a, p = seen(spark, sf_dir), table("pdfs")(spark, sf_dir).select("id", C("user_id").alias("owner"))
    few = a.few.join(p, "id").select("user_id", "id", (C("owner") == C("user_id")).alias("owned"))
    more = a.further().select("user_id", "id", F.when(C("user_id").isNotNull(), False).alias("owned"))
    return few.unionByName(more).withColumn("access", F.when(C("owned"), "owner").otherwise("shared"))


def scopes(spark, sf_dir):
    """ALG11: scopes meet the packs, not the documents."""
    a, p, up = seen(spark, sf_dir), table("pdfs")(spark, sf_dir).select("id", C("deck_id").alias("deck")), table("closure")(spark, sf_dir).select(C("id").alias("deck"), C("ancestor").alias("scope"))
    few = a.few.join(p, "id").join(up, "deck").select("user_id", "scope", "id", C("kind").alias("origin"))
    more = a.further(stored(a.reach.join(up, "deck"), "scopes"))
    return few.unionByName(more.withColumn("origin", F.lit(access.DECK_SHARE)))


def bank_preview(spark, sf_dir):
    """AGG30."""
    return access.previews(*(table(n)(spark, sf_dir) for n in ("pdfs", "shared_banks", "members", "closure")))


def option_overlap(spark, sf_dir):
    """STR31: words shared by two options over the fewer words of either, for those that share any. Rows of one id meet in one row, so no word is joined."""
    o = Plan("SELECT id, UNIQUE(WORDS(lower(o1))) AS a, UNIQUE(WORDS(lower(o3))) AS b FROM {option_sets}", MORE)(spark, sf_dir).where("id is not null")
    each = o.groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    met = each.withColumn("both", F.array_intersect(F.flatten("a"), F.flatten("b"))).where(F.size("both") > 0)
    fewest = lambda c: F.array_min(F.transform(F.filter(c, lambda ws: F.arrays_overlap(ws, C("both"))), F.size))
    return met.select("id", (F.floor(F.size("both").cast("double") / F.least(fewest("a"), fewest("b")) * 1000000 + 0.5) / 1000000).alias("overlap"))


# orders and quantiles --------------------------------------------------------------------------------------------------


def place(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    return ranking.ranked(df, order, name=name)


def ordered(spark, sf_dir):
    """SRT01."""
    return place(table("pdfs")(spark, sf_dir).select("id", "page_count"), [F.desc("page_count"), F.asc("id")]).select("id", "place")


def ranked_decks(spark, sf_dir):
    """SRT02: depth, position, name, id."""
    decks, up = table("decks")(spark, sf_dir), table("closure")(spark, sf_dir)
    depth = up.groupBy("id").agg(F.max("depth").alias("depth"))
    each = decks.select("id", "position", "name").join(depth, "id")
    return place(each, [F.asc("depth"), F.asc("position"), F.asc("name"), F.asc("id")]).select("id", "place")


def switchable(spark, sf_dir):
    """SRT05: two orders of one table."""
    a = table("attempts")(spark, sf_dir).groupBy("question_id").agg(F.count("flag_reason").alias("flags"), F.count("*").alias("n"))
    one = place(a, [F.desc("flags"), F.asc("question_id")], "by_flags")
    return place(one, [F.desc("n"), F.asc("question_id")], "by_attempts").select("question_id", "by_flags", "by_attempts")


def red_zone(spark, sf_dir):
    """SRT10."""
    return place(table("pdfs")(spark, sf_dir).where("balance < 0").select("id", "balance"), [F.asc("balance"), F.asc("id")])


def deck_ranks(spark, sf_dir):
    """WIN20."""
    r = ranking.ranked(table("deck_paths")(spark, sf_dir), [F.asc("path"), F.asc("id")], name="rank").select(C("id").alias("deck_id"), "rank")
    return table("pdfs")(spark, sf_dir).select("id", "deck_id").join(r, "deck_id", "left").select("id", "rank")


def median_values(spark, sf_dir):
    """AGG36."""
    got = ranking.medians(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")
    return got.select("event_type", (F.floor(C("median") * 1000000 + 0.5) / 1000000).alias("median_value"))


# vectors ---------------------------------------------------------------------------------------------------------------


def list_search(spark, sf_dir):
    """QRK12: the eight most similar rows as an inverted file of 100 lists finds them; joi14_exact_knn is the exact way."""
    v, b = table("vectors")(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    asked = v.where("id % 100 = 0").select("id").unionByName(b.select(C("item_id").cast("long").alias("id")))
    index, centres = retrieval.inverted_file(v)
    return retrieval.nearest_by_lists(index, centres, asked)


QUERIES = {
    "joi16_name_containment": name_containment,
    "joi18_association_peers": association_peers,
    "joi09_anti_priority": seen_kinds,
    "joi10_grants": grants,
    "prj05_owned_shared": owned_shared,
    "alg11_scope": scopes,
    "agg30_bank_preview": bank_preview,
    "str31_overlap": option_overlap,
    "srt01_ordered": ordered,
    "srt02_ranked_decks": ranked_decks,
    "srt05_switchable": switchable,
    "srt10_red_zone": red_zone,
    "win20_deck_rank": deck_ranks,
    "agg36_median": median_values,
    "qrk12_list_search": list_search,
}
ORACLE: dict[str, str] = {}


# contexts, samples, answers, progress ----------------------------------------------------------------------------------

FIX |= {
    # a concept for each document: named by its first words, at home in its own chunk and the next one of its book of 40
    "context_words": "SELECT doc_id AS id, CAST(floor(doc_id / 40) AS BIGINT) AS book, WORDS(SWAP(lower(coalesce(text, '')), '[^a-z0-9]', ' ')) AS ws FROM {documents}",
    "context_concepts": "SELECT id, book, HEAD(ws, 3) AS facts, CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS importance, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('about ', ITEM(ws, 0)) END AS relevance, HEAD(ws, 5) AS associations FROM {context_words}",
    "context_terms": "SELECT DISTINCT id, book, term FROM (SELECT id, book, EXPLODED(HEAD(ws, 6)) AS term FROM {context_words}) AS x",
    "context_postings": "SELECT id AS chunk, book, term, count(*) AS tf FROM (SELECT id, book, EXPLODED(ws) AS term FROM {context_words}) AS x GROUP BY id, book, term",
    "context_scores": "SELECT t.id, p.chunk, floor(sum(p.tf * 2.5e0 / (p.tf + 1.5e0)) * 1e6 + 0.5e0) / 1e6 AS score FROM {context_terms} t JOIN {context_postings} p ON p.book = t.book AND p.term = t.term GROUP BY t.id, p.chunk",
    "context_near": "SELECT c.id, s.chunk, s.score FROM {context_concepts} c JOIN {context_scores} s ON s.id = c.id + 1 WHERE c.id % 5 <> 0",
    "context_own": "SELECT id, id AS chunk, 0 AS pos FROM {documents_ids} UNION ALL SELECT a.id, b.id, 1 FROM {documents_ids} a JOIN {documents_ids} b ON b.id = a.id + 1 WHERE CAST(floor(a.id / 40) AS BIGINT) = CAST(floor(b.id / 40) AS BIGINT) AND a.id % 2 = 0",
    "documents_ids": "SELECT doc_id AS id FROM {documents}",
    "context_chunks": "SELECT doc_id AS chunk, concat(coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN ' a patient with \"fever\"' ELSE '' END) AS text, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS start_page, CASE doc_id % 2 WHEN 0 THEN doc_id ELSE doc_id + 1 END AS end_page FROM {documents}",
    "leveled": "SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' WHEN 2 THEN 'L3' WHEN 3 THEN 'L9' WHEN 4 THEN NULL ELSE concat('L', CAST(doc_id % 3 + 1 AS STRING)) END AS level FROM {documents}",
    "model_texts": """
        SELECT event_id AS id, CASE event_id % 12
          WHEN 0 THEN concat('```json', chr(10), '[', o, ', ', o, ']', chr(10), '```')
          WHEN 1 THEN concat('Here it is: ', o)
          WHEN 2 THEN concat('```', chr(10), o, chr(10), '``` and some more')
          WHEN 3 THEN concat('[', o, ', ', o, '] as asked')
          WHEN 4 THEN concat('[', o, ', ', chr(123), '\"id\": 4, \"kin')
          WHEN 5 THEN 'nothing of the kind'
          WHEN 6 THEN concat(o, ', ', o)
          WHEN 7 THEN concat(chr(123), '\"id\": ', CAST(event_id AS STRING), ', \"in\": ', o, ', \"s\": \"a ', chr(125), ' b [ ', chr(92), '\" \"', chr(125), ' thanks')
          WHEN 8 THEN concat('  ', chr(123), chr(125), ' ')
          WHEN 9 THEN concat(o, ']')
          WHEN 10 THEN concat('[1, \"', event_type, '\", null, [true]]')
          ELSE concat(chr(123), '\"id\": ', CAST(event_id AS STRING), ', \"cut\": [1, 2') END AS text
        FROM (SELECT *, concat(chr(123), '\"id\": ', CAST(event_id AS STRING), ', \"kind\": \"', event_type, '\"', chr(125)) AS o FROM {events}) AS x""",
    "progress_events": "SELECT conv_id AS job_id, turn AS seq, 1704067200000000 + conv_id * 1000000 + turn * (10 + conv_id % 5 * 17) * 1000000 AS at_us, CAST(least(7, turn + conv_id % 3) AS INT) AS phase, CAST(least(100, turn * 15) AS INT) AS pct, CASE WHEN conv_id % 3 = 0 AND turn = 4 THEN ' Done ' ELSE role END AS message FROM {conversations}",
}


def contexts(spark, sf_dir):
    from studymill.operators.contexts import concept_contexts

    of = lambda n: table(n)(spark, sf_dir)
    scores = stored(of("context_scores"), "scores")
    near = scores.select((C("id") - 1).alias("id"), "chunk", "score").where("id % 5 <> 0").join(of("documents_ids"), "id", "left_semi")  # as the fixture context_near
    got = concept_contexts(of("context_concepts").drop("book"), of("context_own"), scores, near, of("context_chunks"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return got.select("id", text("chunks").alias("chunks"), text("levels").alias("levels"), "facts", F.md5("passages").alias("passages"), F.md5(F.array_join("neighbours", "|")).alias("neighbours"))


def golden(spark, sf_dir):
    from studymill.operators.sampling import golden_set

    return golden_set(table("leveled")(spark, sf_dir), ["L1", "L2", "L3"])


def parsed_texts(spark, sf_dir):
    """JSN01: kind, number of parts and id of what is read of each text; nulls where nothing is."""
    from studymill.functions.jsonparse import parsed

    t = table("model_texts")(spark, sf_dir).select("id", parsed(C("text")).alias("v"))
    items, fields = F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$", "map<string,variant>")
    kind = F.when(items.isNotNull(), "array").when(fields.isNotNull(), "object")
    return t.select("id", kind.alias("kind"), F.when(items.isNotNull(), F.size(items)).when(fields.isNotNull(), F.size(fields)).cast("long").alias("n"), F.coalesce(F.try_variant_get("v", "$.id", "long"), F.try_variant_get("v", "$[0].id", "long")).alias("found"))


def progress_rows(spark, sf_dir):
    from studymill.streaming.ordered import progress

    e = table("progress_events")(spark, sf_dir)
    return progress(e.select("job_id", "seq", F.timestamp_micros("at_us").alias("at"), "phase", "pct", "message"))


QUERIES |= {"alg24_contexts": contexts, "srt12_golden_set": golden, "jsn01_parsed": parsed_texts, "stm01_progress": progress_rows}


def duck(sql: str) -> str:
    return Plan(sql, FIX).duckdb()


ORACLE |= {
    "srt12_golden_set": duck("""
        SELECT id, level, place FROM (
          SELECT id, level, row_number() OVER (ORDER BY l, nth) AS place FROM (
            SELECT id, level, l, row_number() OVER (PARTITION BY l ORDER BY md5('golden:' || id), id) AS nth FROM (SELECT id, level, coalesce(level, 'L2') AS l FROM {leveled}) a WHERE l IN ('L1', 'L2', 'L3')) b WHERE nth <= 17) c
        WHERE place <= 50"""),
    "alg24_contexts": duck(r"""
        SELECT c.id, coalesce(x.chunks, '') AS chunks,
          CASE WHEN importance = 'high' THEN CASE WHEN coalesce(x.clinical, false) THEN '1,2,3' ELSE '1,2' END WHEN importance = 'low' THEN '1' ELSE '1,2' END AS levels,
          array_to_string(list_filter(list_concat(facts, [relevance], associations[1:3]), lambda f: f <> ''), '; ') AS facts, md5(coalesce(x.passages, '')) AS passages, md5(coalesce(y.snippets, '')) AS neighbours
        FROM {context_concepts} c
        LEFT JOIN (
          SELECT p.id, string_agg(CAST(p.chunk AS VARCHAR), ',' ORDER BY place) AS chunks,
            string_agg('> "' || replace(text[1:700], '"', '''') || '" [' || CASE WHEN start_page <> end_page THEN 'pages ' || start_page || '–' || end_page ELSE 'page ' || coalesce(CAST(start_page AS VARCHAR), '?') END || ']', chr(10) ORDER BY place) AS passages,
            bool_or(regexp_matches(text, '(?i)(^|[^a-z0-9_])(patient|presents?|year.old|male|female|complain|symptom|sign|vital|lab|imaging|exam|diagnosis|management|treatment|history|physical|workup|finding|fever|pain|dyspnea|fatigue|nausea|vomiting|diarrhea|rash|edema|tachycardia|bradycardia|hypertension|hypotension|biopsy|CBC|BMP|CXR|CT|MRI|EKG|ECG)($|[^a-z0-9_])') AND len(regexp_split_to_array(text, '\s+')) <= 400) AS clinical
          FROM (
            SELECT id, chunk, row_number() OVER (PARTITION BY id ORDER BY kind, rank, chunk) AS place FROM (
              SELECT id, chunk, 0 AS kind, CAST(pos AS DOUBLE) AS rank FROM {context_own}
              UNION ALL SELECT s.id, s.chunk, 1, 0 - s.score FROM {context_scores} s WHERE NOT EXISTS (SELECT 1 FROM {context_own} o WHERE o.id = s.id AND o.chunk = s.chunk)) u) p
          JOIN {context_chunks} k ON k.chunk = p.chunk WHERE place <= 4 GROUP BY p.id) x ON x.id = c.id
        LEFT JOIN (
          SELECT n.id, string_agg(k.text[1:200], '|' ORDER BY place) AS snippets FROM (SELECT id, chunk, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS place FROM {context_near}) n
          JOIN {context_chunks} k ON k.chunk = n.chunk WHERE place <= 2 GROUP BY n.id) y ON y.id = c.id"""),
    "jsn01_parsed": duck(r"""
        SELECT id, CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind,
          CASE json_type(v) WHEN 'ARRAY' THEN CAST(json_array_length(v) AS BIGINT) WHEN 'OBJECT' THEN CAST(len(json_keys(v)) AS BIGINT) END AS n,
          CAST(coalesce(json_extract_string(v, '$.id'), json_extract_string(v, '$[0].id')) AS BIGINT) AS found
        FROM (
          SELECT id, CASE WHEN json_valid(s) THEN CAST(s AS JSON) WHEN s[1] = chr(123) AND json_valid(o) THEN CAST(o AS JSON) END AS v FROM (
            SELECT id, s, CASE WHEN id % 12 = 7 THEN regexp_replace(s, ' thanks$', '') WHEN id % 12 = 6 THEN s ELSE regexp_extract(s, '^[{][^{}]*[}]') END AS o FROM (
              SELECT id, regexp_extract(trim(regexp_replace(regexp_replace(text, '```json\n?', '', 'g'), '```\n?', '', 'g'), E' \t\n\r'), '[\[{](.|\n)*') AS s FROM {model_texts}) a) b) c"""),
    "stm01_progress": duck("""
        WITH e AS (SELECT job_id, seq, CAST(at_us // 1000 AS BIGINT) AS t, phase, pct, coalesce(phase = 7 OR lower(trim(message)) = 'done', false) AS ends FROM {progress_events}),
        f AS (SELECT job_id, min(t) AS t0, min(t) FILTER (ends) AS stop FROM e GROUP BY job_id),
        g AS (SELECT e.*, t0 + 285000 AS lim FROM e JOIN f ON f.job_id = e.job_id WHERE t <= t0 + 285000 AND (stop IS NULL OR t <= stop)),
        h AS (SELECT *, lead(t) OVER (PARTITION BY job_id ORDER BY t, seq) AS nxt FROM g)
        SELECT job_id, t AS at_ms, 'event' AS kind, seq, phase, pct FROM h
        UNION ALL SELECT job_id, b, 'heartbeat', NULL, NULL, NULL FROM (SELECT job_id, unnest(generate_series(t + 20000, coalesce(nxt, lim) - 1, 20000)) AS b FROM h WHERE NOT ends) q
        UNION ALL SELECT job_id, lim, 'timeout', NULL, NULL, NULL FROM h WHERE nxt IS NULL AND NOT ends"""),
}

FIX |= {
    "definition_drafts": """
        SELECT id, CAST(floor(id / 40) AS BIGINT) AS book, CASE WHEN id % 9 = 0 THEN 2 ELSE 1 END AS level, CASE id % 4 WHEN 0 THEN 'entity_recall' WHEN 1 THEN 'pressure_volume_quantitative' ELSE 'definition_recall' END AS domain,
          CASE id % 5 WHEN 0 THEN concat(a, ' (', b, ')') WHEN 1 THEN concat(a, '/', c) WHEN 2 THEN concat(a, ' pressure') ELSE concat(a, ' ', b, ' ', c) END AS name, CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS importance,
          CASE id % 6 WHEN 0 THEN PARTS(concat(a, '|', b, '|', c, '|', d)) WHEN 1 THEN PARTS(concat('The ', a, ' of the ', b, ' that is there|ability of ', c, ' to be more than it|Capacity of ', d, ' to be less than that|', a))
            ELSE PARTS(concat('the ', a, ' ', b, ' in ', c, ' of it|Increase in ', d, ' when ', a, ' falls again|  The rate at which ', b, ' is made new|capacity of a thing to ', c, ' and more|', d)) END AS options,
          CASE id % 7 WHEN 0 THEN 9 WHEN 1 THEN -1 ELSE id % 5 END AS answer, CASE id % 4 WHEN 1 THEN s0 END AS quote, CASE id % 5 WHEN 0 THEN concat(s0, ' ', s1, ' ', s0) WHEN 1 THEN concat(a, ' falls.') WHEN 2 THEN '.' END AS clue,
          CASE id % 4 WHEN 0 THEN concat(' ', d, ' ', b) WHEN 1 THEN concat('The rate of ', a) WHEN 2 THEN a END AS distractor, CASE id % 3 WHEN 0 THEN 'It is near.' END AS tempting, CASE id % 8 WHEN 3 THEN 'It is not. ' END AS fails, PARTS(concat(d, ' ', c, '|', a, '|', b, ' disease')) AS candidates
        FROM {draft_parts}""",
}


def rewritten_drafts(spark, sf_dir):
    """ALG20: the drafts that are rewritten."""
    from studymill.functions.rewrite import choice_pool, rewritten

    d = table("definition_drafts")(spark, sf_dir)
    books = d.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("id", "name", "domain", "importance"))).alias("siblings"))  # the concepts of a document
    pool = choice_pool(C("candidates"), C("siblings"), C("id"), C("domain"))
    got = d.join(books, "book").withColumn("pool", pool)
    new = rewritten(C("level"), C("domain"), C("name"), F.array("name"), C("options"), C("answer"), C("quote"), C("clue"), C("distractor"), C("tempting"), C("fails"), C("pool"))
    return got.select("id", new.alias("x")).where("x is not null").select("id", "x.stem", F.array_join("x.options", " ~ ").alias("options"), "x.answer", "x.distractor", "x.tempting", "x.fails", "x.explanation")


QUERIES["alg20_rewritten"] = rewritten_drafts

# a quote with the place that its writer gave: within a run of signs, where only the place tells it
FIX |= {
    "placed_quotes": """
        SELECT id, source, CASE id % 5 WHEN 0 THEN concat(';  ', w0, ' ', substring(w1, 1, 6)) WHEN 1 THEN concat('; ', w0, ' ', substring(w1, 1, 6)) WHEN 2 THEN concat(w0, ' ', w1, ' ', w0) WHEN 3 THEN concat('; ', w1, ' ', w0, ' nowhere') END AS quote,
          CASE WHEN id % 7 <> 0 THEN CAST(instr(source, '.; zq') AS INT) END AS a, CAST(instr(source, '.; zq') + CASE WHEN id % 11 = 0 THEN 1 ELSE length(concat('; ', w0, ' ', substring(w1, 1, 6))) END AS INT) AS b
        FROM (SELECT doc_id AS id, concat(coalesce(text, ''), '.; zq', CAST(doc_id AS STRING), 'qz stands ', 'herein at last') AS source, concat('zq', CAST(doc_id AS STRING), 'qz') AS w0, 'stands herein' AS w1 FROM {documents}) AS x""",
}


def placed_evidence(spark, sf_dir):
    """ALG05 for drafts whose chunk is given, with the places that the writer gave."""
    from studymill.functions.text import evidence

    d = table("placed_quotes")(spark, sf_dir)
    e = evidence(C("quote"), C("source"), start=C("a"), end=C("b"))
    return d.select("id", e.alias("e")).select("id", "e.type", (F.floor(C("e.confidence") * 1000 + 0.5) / 1000).alias("confidence"))


QUERIES["alg05_given_places"] = placed_evidence

# Oracles from the rules for plans whose own text is another: prefix sums as lists, islands by their two ends, integer remainders.
ORACLE |= {
    "win12_slots": duck("""
        SELECT pdf_id, id, n AS n_levels, CAST(list_sum(ns[1:k]) AS BIGINT) AS running FROM (
          SELECT pdf_id, unnest(ids) AS id, unnest(ns) AS n, unnest(generate_series(1, len(ids))) AS k, ns FROM (
            SELECT pdf_id, list(id ORDER BY pos) AS ids, list(CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END ORDER BY pos) AS ns FROM {concepts} GROUP BY pdf_id) a) b
        WHERE k = 1 OR list_sum(ns[1:k]) <= 30"""),
    "win13_merged_intervals": duck("""
        WITH i AS (SELECT DISTINCT user_id, time_spent_ms AS a, time_spent_ms + 400 + id % 900 AS b FROM {attempts}),
        s AS (SELECT user_id, a, row_number() OVER (PARTITION BY user_id ORDER BY a) AS k FROM (SELECT DISTINCT user_id, a FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.user_id = i.user_id AND j.a < i.a AND j.b >= i.a)) x),
        e AS (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY b) AS k FROM (SELECT DISTINCT user_id, b FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.user_id = i.user_id AND j.a <= i.b AND j.b > i.b)) x)
        SELECT s.user_id, s.a, e.b FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k"""),
    "win22_apportion": duck("""
        WITH d AS (SELECT CAST(doc_id // 40 AS BIGINT) AS pdf_id, doc_id AS id, length(text) AS n FROM {documents}),
        t AS (SELECT pdf_id, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY pdf_id),
        r AS (SELECT d.pdf_id, id, n, 40 * n // total AS whole, 40 * n % total AS rest FROM d JOIN t ON t.pdf_id = d.pdf_id)
        SELECT a.pdf_id, a.id, CAST(a.whole + CASE WHEN (SELECT count(*) FROM r b WHERE b.pdf_id = a.pdf_id AND (b.rest, b.n, -b.id) > (a.rest, a.n, -a.id)) < 40 - (SELECT sum(whole) FROM r c WHERE c.pdf_id = a.pdf_id) THEN 1 ELSE 0 END AS BIGINT) AS target FROM r a"""),
}
