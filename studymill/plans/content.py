"""Queries whose Spark form is a DataFrame program rather than shared SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from studymill.functions import text as T
from studymill.functions.jsonrepair import repair_json
from studymill.functions.windows import window_ratios
from studymill.operators import chunking, concepts, dedup, matching, scheduling
from studymill.operators.ranking import checked
from studymill.sources.fixtures import FIXTURES
from studymill.sources.scratch import stored
from studymill.streaming.states import latest_states

from .plan import Plan
from .relational import SQL


def table(name: str):
    """The fixture of this name as a DataFrame."""
    return Plan(f"SELECT * FROM {{{name}}}", FIXTURES)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark, sf_dir):
    """Pages of books of 40, so that books grow in number with the documents and not in length."""
    return documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 40).alias("pdf_id"), F.col("doc_id").alias("page"), "text")


def sm2_fold(spark, sf_dir):
    return scheduling.rounded(scheduling.fold(table("reviews")(spark, sf_dir)))


def word_windows(spark, sf_dir):
    return chunking.word_windows(documents(spark, sf_dir).select(F.col("doc_id").alias("pdf_id"), F.lit(1).alias("page"), "text"), 60, 0.15).select("pdf_id", "chunk", "word_count", F.md5("text").alias("text_md5"))


def word_windows_pages(spark, sf_dir):
    return chunking.word_windows(pages(spark, sf_dir), *chunking.DENSITY["standard"])


def structural(spark, sf_dir):
    return chunking.structural_chunks(pages(spark, sf_dir), *chunking.DENSITY["standard"])


def questions_with_vectors(spark, sf_dir):
    d = documents(spark, sf_dir)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return d.join(v, d["doc_id"] == v["vec_id"], "left").select(F.floor(F.col("doc_id") / 1000).alias("bank"), F.col("doc_id").alias("id"), F.col("text").alias("stem"), (F.col("doc_id") % 3 + 1).cast("int").alias("level"), F.when(F.col("doc_id") % 5 == 0, "high").otherwise("low").alias("importance"), F.lit(None).cast("string").alias("chunk_id"), "embedding")


def question_duplicates(spark, sf_dir):
    return dedup.duplicates(questions_with_vectors(spark, sf_dir))


def queues(spark, sf_dir):
    q, s, m = (table(t)(spark, sf_dir) for t in ("questions", "srs_state", "mastery"))
    state = s.select("user_id", F.col("question_id").alias("id"), "times_reviewed", "next_review", "last_reviewed")
    # each user's items: those of the banks (pdf_id) in which the user has a state
    seen = s.select("user_id", "pdf_id").distinct()
    mine = q.select("id", "concept_id", "level", "pdf_id").join(seen, "pdf_id").drop("pdf_id")
    mine = mine.join(state, ["user_id", "id"], "left").withColumn("importance", F.when(F.col("concept_id") % 3 == 0, "high").otherwise("low"))
    status = F.when(F.col("overall") < 40, "weak").when(F.col("overall") < 70, "medium").when(F.col("overall") < 90, "strong").otherwise("mastered")
    level = F.when(F.col("l1") < 60, 1).when(F.col("l2") < 60, 2).otherwise(3)
    mastery = m.select("user_id", "concept_id", "overall", status.alias("status"), level.alias("target_level"), F.when(F.col("concept_id") % 3 == 0, "high").otherwise("low").alias("importance"))
    return scheduling.study_queues(mine, mastery, 1704672000000000)


def evidence_candidates(quotes, docs):
    """(item_id, doc_id) of all pairs of quotes(item_id, quote) and docs(doc_id, text) that ALG05 can accept.

    The text holds the quote or one of its clauses, or it has the quote's content word pairs 0.6 times their number or
    more, counted as often as they stand in it: no window of a fuzzy match can hold more. A quote of white space alone is
    taken as missing.
    """
    pairs = lambda plain: T.pairs_of(T.content_words(T.evidence_words(plain)))
    plain = stored(docs.select("doc_id", T.evidence_text(F.col("text")).alias("plain")), "plain")
    part = F.explode(F.array_union(F.array(T.evidence_text(F.col("quote"))), F.filter(F.transform(F.split("quote", "[;•]"), T.evidence_text), lambda x: F.length(x) >= 12)))
    whole = matching.contained(quotes, docs, "item_id", "quote", "doc_id", "text")
    clauses = matching.contained(quotes.select("item_id", part.alias("part")), plain, "item_id", "part", "doc_id", "plain")
    held = whole.union(clauses).select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"))
    wanted = quotes.select("item_id", F.array_distinct(pairs(T.evidence_text(F.col("quote")))).alias("pairs")).select("item_id", F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    wanted = checked(stored(wanted, "wanted"))
    shared = plain.select("doc_id", F.explode(pairs(F.col("plain"))).alias("pair")).join(wanted, "pair").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"), F.max("n").alias("n"))
    return held.union(shared.where(F.col("hits") / F.col("n") >= 0.6).select("item_id", "doc_id")).distinct()


def evidence_found(quotes, docs):
    """(item_id, doc_id, type, confidence) of the pairs that ALG05 accepts; windows are tried only where nothing else holds."""
    met = evidence_candidates(quotes, docs).join(quotes, "item_id").join(docs, "doc_id")
    met = met.withColumn("e", T.evidence(F.col("quote"), F.col("text"), fuzzy=False))
    open_ = (F.col("e.type") == "none") & (F.length("quote") >= 20) & (F.col("quote") != "UNGROUNDED")
    met = met.withColumn("ratio", window_ratios(F.when(open_, T.evidence_text(F.col("quote"))), F.when(open_, T.evidence_text(F.col("text")))))
    kind = F.when(F.col("e.type") != "none", F.col("e.type")).when(F.col("ratio") >= 0.6, "fuzzy")
    return met.select("item_id", "doc_id", kind.alias("type"), F.when(kind == "fuzzy", F.col("ratio")).otherwise(F.col("e.confidence")).alias("confidence")).where("type is not null")


def evidence_types(spark, sf_dir):
    """ALG05 over quotes of the benchmark, some with doubled spaces or a word put in after the first, against all documents."""
    put_in = F.regexp_replace("text", r"^(\S+) ", "$1 indeed ")
    quote = F.when(F.col("item_id") % 2 == 0, F.regexp_replace("text", " ", "  ")).when(F.col("item_id") % 4 == 1, put_in).otherwise(F.col("text"))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", quote.alias("quote"))
    return evidence_found(b, documents(spark, sf_dir).select("doc_id", "text"))


def stem_rules(spark, sf_dir):
    c = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(c).alias("fingerprint"), T.slug(c).alias("slug"), T.is_interrogative(c).alias("interrogative"), T.is_negation(c).alias("negation"), T.quote_fault(c).alias("quote_fault"))


def text_forms(spark, sf_dir):
    c = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.md5(T.plain(c)).alias("plain"), F.md5(T.label(c)).alias("label"))


def option_audit(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    options = F.array(F.concat("p_name", F.lit(" level")), F.concat("p_type", F.lit(" ion level")), F.concat("p_brand", F.lit(" (x) rate value")), F.col("p_name"))
    return p.select("p_partkey", F.array_join(T.option_flags(options, (F.col("p_partkey") % 4).cast("int")), ",").alias("flags"), T.length_fault(options, (F.col("p_partkey") % 4).cast("int")).alias("length_fault"))


#: Elements whose end begins a new line, and named entities (fixed values).
LINE_ENDS = "p|div|li|ul|h[1-6]|article|title|nav|tr|table|section"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "copy": "©", "middot": "·", "amp": "&"}


def page_texts(spark, sf_dir):
    """SRC03 by analogy: the text of pages, without markup, a line for each block; blank lines are passed over."""
    t = F.col("html")
    for pattern, to in ((r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"[\t\n\r]+", " "), (rf"(?i)<br */?>|</({LINE_ENDS})>", "\n"), (r"(?s)<[^>]*>", " ")):
        t = F.regexp_replace(t, pattern, to)
    for name, sign in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    lines = F.filter(F.transform(F.split(t, "\n"), T.squeezed), lambda x: x != "")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.array_join(lines, "\n").alias("text"))


def repaired_json(spark, sf_dir):
    """JSN02: eleven kinds of damage, of which one leaves nothing to read."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    put = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    kinds = [
        put("Here: ```json [{id: ", n, ", 'kind': '", kind, "',}, "),
        put('```json\n[{"id": ', n, ', "kind": "', kind, '"}]\n```'),
        put("[{“id”: ", n, ", “kind”: “", kind, "”}]"),
        put('[{"id": ', n, ', "kind": "', kind, '"}, '),
        put('It is {"id": ', n, ', "kind": "', kind, '"}'),
        put('[{"id": ', n, ', "kind": "say "', kind, '" now"}]'),
        put('[{"id": ', n, ', "kind": "', kind),
        put('[{"id": ', n, ', "kind": "', kind, '"}] hope it helps'),
        put('[{"id": ', n, ', "kind": "', kind, '",},]'),
        put("no array for ", kind),
        put('[{"id": ', n, ', kind: ["', kind, "', 'x"),
    ]
    broken = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", repair_json(broken).alias("json"))


def job_states(spark, sf_dir):
    return latest_states(table("process_events")(spark, sf_dir))


def raw_concepts(spark, sf_dir):
    one = lambda c: F.array(F.col(c))
    c = table("concepts")(spark, sf_dir)
    return c.select("pdf_id", "pos", "name", "category", "importance", one("fact").alias("facts"), F.array("category").alias("associations"), F.concat("name", F.lit(" matters")).alias("relevance"), F.array(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("chunk_ids"))


def inventory(spark, sf_dir):
    got = concepts.merged_inventory(raw_concepts(spark, sf_dir))
    return got.select("pdf_id", "merge_key", "importance", F.array_join("facts", ",").alias("facts"), F.size("chunk_ids").cast("long").alias("chunks"))


def canonical_concepts(spark, sf_dir):
    got = concepts.canonicalised(concepts.merged_inventory(raw_concepts(spark, sf_dir)))
    return got.select("pdf_id", "place", "name", "importance", F.array_join("aliases", "; ").alias("aliases"))


QUERIES = {
    "agg25_inventory": inventory,
    "alg04_canonical_concepts": canonical_concepts,
    "alg08_sm2_fold": sm2_fold,
    "win01_word_windows": word_windows,
    "win01_word_windows_of_pages": word_windows_pages,
    "win02_structural_chunks": structural,
    "alg03_question_duplicates": question_duplicates,
    "alg10_study_queues": queues,
    "alg05_evidence": evidence_types,
    "str_stem_rules": stem_rules,
    "str04_text_forms": text_forms,
    "arr03_option_audit": option_audit,
    "src03_page_texts": page_texts,
    "jsn02_repaired_json": repaired_json,
    "stm03_job_states": job_states,
}

ORACLE = {
    "agg25_inventory": """
        WITH c AS (
          SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS pdf_id, p_partkey AS pos, concat(substring(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 1, 30), '|', substring(regexp_replace(lower(p_type), '[^a-z]', '', 'g'), 1, 10)) AS merge_key,
            CASE WHEN p_size > 33 THEN 3 WHEN p_size > 16 THEN 2 ELSE 1 END AS rank, p_brand AS fact, p_partkey % 7 AS chunk FROM part),
        f AS (SELECT pdf_id, merge_key, fact, row_number() OVER (PARTITION BY pdf_id, merge_key ORDER BY min(pos)) AS n FROM c GROUP BY pdf_id, merge_key, fact),
        g AS (SELECT pdf_id, merge_key, string_agg(fact, ',' ORDER BY n) AS facts FROM f WHERE n <= 6 GROUP BY pdf_id, merge_key)
        SELECT c.pdf_id, c.merge_key, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS importance, any_value(g.facts) AS facts, count(DISTINCT chunk) AS chunks
        FROM c JOIN g ON g.pdf_id = c.pdf_id AND g.merge_key = c.merge_key GROUP BY c.pdf_id, c.merge_key""",
    "alg08_sm2_fold": Plan(SQL["alg08_sm2_fold"], FIXTURES).duckdb(),
    "win01_word_windows": r"""
        WITH d AS (SELECT doc_id AS pdf_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
        s AS (SELECT pdf_id, ws, len(ws) AS n, unnest(generate_series(0, len(ws) - 1, 51)) AS a FROM d WHERE len(ws) > 0),
        e AS (SELECT pdf_id, ws, n, a, list_filter(generate_series(least(a + 60, n), least(least(a + 60, n) + 40, n)), lambda x: x = least(least(a + 60, n) + 40, n) OR regexp_matches(ws[x], '[.?!]$'))[1] AS b FROM s),
        k AS (SELECT *, lag(b) OVER (PARTITION BY pdf_id ORDER BY a) AS before FROM e)
        SELECT pdf_id, row_number() OVER (PARTITION BY pdf_id ORDER BY a) - 1 AS chunk, CAST(b - a AS BIGINT) AS word_count, md5(array_to_string(ws[a + 1 : b], ' ')) AS text_md5
        FROM k WHERE b - a >= 20 AND (before IS NULL OR before < n)""",
    "str04_text_forms": r"""
        SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS plain, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS label FROM documents""",
    "src03_page_texts": r"""
        WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '[\t\n\r]+', ' ', 'g') AS t FROM pages),
        d AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br */?>|</(p|div|li|ul|h[1-6]|article|title|nav|tr|table|section)>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM c),
        e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM d)
        SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM e""",
    "stm03_job_states": "WITH e AS (SELECT conv_id AS job_id, turn AS seq, least(100, turn * 15) AS pct, role AS phase, length(text) % 3 AS metric FROM conversations) SELECT job_id, arg_max(pct, seq) AS pct, arg_max(phase, seq) AS phase, max(seq) AS seq, CAST(arg_max(metric, seq) FILTER (metric <> 0) AS BIGINT) AS metric FROM e GROUP BY job_id",
    "jsn02_repaired_json": r"""
        SELECT event_id, CASE event_id % 11 WHEN 9 THEN NULL WHEN 5 THEN '[{"id":' || event_id || ',"kind":"say \"' || event_type || '\" now"}]'
          WHEN 10 THEN '[{"id":' || event_id || ',"kind":["' || event_type || chr(39) || ', ' || chr(39) || 'x"]}]' ELSE '[{"id":' || event_id || ',"kind":"' || event_type || '"}]' END AS json FROM events""",
}
