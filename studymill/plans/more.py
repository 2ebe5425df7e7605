"""Further queries by operator id: predicates, orders, array and text rules, in the SQL that both engines share."""

from __future__ import annotations

from studymill.sources.drafts import DRAFTS
from studymill.sources.fixtures import AS_OF

from .plan import Plan
from .relational import R6, ROUND

#: An option text in lower case, without label and signs.
PLAIN = "trim(SWAP(SWAP(lower({0}), '[^a-z0-9 ]', ' '), ' +', ' '))".format

#: Words of each of some texts; the upper median of some lengths (index floor(n / 2) in order).
COUNTS, UPPER = "EACH({0}, SIZE(WORDS(x)))".format, "ITEM(SORTED({0}), floor(SIZE({0}) / 2))".format

FIXTURES = DRAFTS | {
    "samples": """
        SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN concat('A. ', p_name, ' (enzyme)') WHEN 1 THEN concat(' b) ADH  ', p_name, ' ') WHEN 2 THEN 'All of the above' WHEN 3 THEN concat('Which of the following is a ', p_type)
          WHEN 4 THEN concat('A 45-year-old ', p_name, ' presents with pain') WHEN 5 THEN concat(p_name, 's, losses and ', lower(p_type), 'ies') WHEN 6 THEN concat('Hello  ', p_name, '!!') WHEN 7 THEN '!!' WHEN 8 THEN concat('It does NOT ', p_name)
          ELSE concat('Chapter 12: ', p_name, ' - a table of contents 101 102 103') END AS s FROM {part}""",
    "answer_texts": "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'b' WHEN 1 THEN CAST(p_partkey % 9 AS STRING) WHEN 2 THEN 'E' WHEN 3 THEN p_name WHEN 4 THEN '' WHEN 5 THEN '17' ELSE 'F' END AS o FROM {part}",
    "option_sets": "SELECT p_partkey AS id, p_partkey % 4 AS answer, p_name AS o0, concat(p_type, ' ', p_name) AS o1, p_brand AS o2, concat(p_name, ' of the kind that is ', lower(p_type)) AS o3 FROM {part}",
    "option_lengths": "SELECT id, lens, own, " + UPPER("lens") + " AS median, ITEM(SORTED(lens), SIZE(lens) - 1) AS high, ITEM(SORTED(lens), 0) AS low FROM (SELECT id, EACH(options, length(x)) AS lens, CASE WHEN answer < SIZE(options) THEN length(ITEM(options, answer)) END AS own FROM {drafts}) AS x",
    "option_words": "SELECT id, CAST(own AS DOUBLE) AS own, CASE WHEN SIZE(counts) > 1 THEN CAST(SUMOF(counts) - own AS DOUBLE) / (SIZE(counts) - 1) END AS others FROM (SELECT id, " + COUNTS("options") + " AS counts, CASE WHEN answer < SIZE(options) THEN SIZE(WORDS(ITEM(options, answer))) END AS own FROM {drafts}) AS x",
    # concepts by document and prefix, the most important first
    "prefixed": "SELECT *, CAST(row_number() OVER (PARTITION BY pdf_id, prefix ORDER BY CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, pos) AS BIGINT) AS place FROM (SELECT *, lower(CASE WHEN length(ITEM(WORDS(name), 0)) > 4 THEN ITEM(WORDS(name), 0) ELSE TEXTOF(HEAD(WORDS(name), 2)) END) AS prefix FROM (SELECT id, pdf_id, pos, SWAP(name, '[^a-zA-Z0-9 ]', '') AS name, importance, fact FROM {concepts}) AS a) AS b",
    "visible": "SELECT user_id, id, min(kind) AS origin FROM {origins} GROUP BY user_id, id",
}

SQL = {
    "src02_match_chunks": "SELECT query_id, id, similarity FROM {nearest} WHERE place <= 5",
    "prj01_projection": "SELECT id, pdf_id, level FROM {questions}",
    "prj06_concept_rows": "SELECT id, name AS summary, category, importance, concat(CASE WHEN category IS NULL THEN '' ELSE category END, '') AS coverage_domain FROM {concepts}",
    "prj07_question_records": "SELECT id, level, stem, n_options, answer FROM {questions} WHERE NOT flagged",
    "fil01_equality": "SELECT id FROM {questions} WHERE pdf_id = 3 AND flagged = false",
    "fil02_in_list": "SELECT id, pdf_id FROM {questions} q WHERE EXISTS (SELECT 1 FROM {pdfs} p WHERE p.id = q.pdf_id AND p.processed)",
    "fil07_optional_filters": "SELECT id FROM {questions} WHERE pdf_id = 4 AND level = 2 AND NOT flagged",
    "fil11_ownership": "SELECT id, name FROM {pdfs} WHERE user_id = 12",
    "fil13_malformed": "SELECT id FROM {questions} WHERE length(trim(stem)) > 0 AND n_options >= 2",
    "fil19_uncategorised": "SELECT id FROM {pdfs} WHERE deck_id IS NULL",
    "joi05_point_lookup": "SELECT q.id, q.level, s.times_reviewed, p.processed FROM (SELECT * FROM {questions} WHERE id = 42) q LEFT JOIN {srs_state} s ON s.question_id = q.id AND s.user_id = 8 LEFT JOIN {pdfs} p ON p.id = q.pdf_id",
    "joi08_scoped_states": "SELECT user_id, question_id FROM {srs_state} s WHERE EXISTS (SELECT 1 FROM {pdfs} p WHERE p.id = s.pdf_id AND p.processed)",
    "joi18_association_peers": "SELECT a.id, b.id AS peer FROM (SELECT x.association, y.name FROM (SELECT DISTINCT ITEM(WORDS(name), 1) AS association FROM {concepts}) x JOIN (SELECT DISTINCT name FROM {concepts}) y ON HOLDS(lower(y.name), lower(x.association))) p JOIN (SELECT id, ITEM(WORDS(name), 1) AS association FROM {concepts}) a ON a.association = p.association JOIN {concepts} b ON b.name = p.name AND a.id <> b.id",
    "agg05_mean_time": "SELECT question_id, " + ROUND("CAST(sum(time_spent_ms) AS DOUBLE) / count(*)") + " AS mean_ms FROM {attempts} GROUP BY question_id",
    "agg12_accuracy": "SELECT user_id, CASE WHEN count(*) > 0 THEN " + ROUND("100.0e0 * count(CASE WHEN is_correct THEN 1 END) / count(*)") + " END AS accuracy FROM {attempts} GROUP BY user_id",
    "agg14_all_mastery": "SELECT concept_id, count(*) AS users, min(overall) AS lowest, max(overall) AS highest FROM {mastery} GROUP BY concept_id",
    "agg21_nested_groups": "SELECT concept_id, JOINED(concat(CAST(level AS STRING), ':', ids), level) AS levels, CAST(sum(n) AS BIGINT) AS n FROM (SELECT concept_id, level, JOINED(CAST(id AS STRING), id) AS ids, count(*) AS n FROM {questions} GROUP BY concept_id, level) AS x GROUP BY concept_id",
    "agg27_folded_prefixes": """
        SELECT b.id, b.prefix, TEXTOF(HEAD(UNIQUE(GATHERED(x.fact, x.place, x.fact)), 8)) AS facts, coalesce(max(l.names), '') AS aliases
        FROM {prefixed} b JOIN {prefixed} x ON x.pdf_id = b.pdf_id AND x.prefix = b.prefix AND (x.place = 1 OR x.place > 4)
        LEFT JOIN (SELECT pdf_id, prefix, JOINED(name, place) AS names FROM {prefixed} WHERE place > 4 GROUP BY pdf_id, prefix) l ON l.pdf_id = b.pdf_id AND l.prefix = b.prefix
        WHERE b.place = 1 GROUP BY b.id, b.prefix""",
    "agg32_deck_groups": "SELECT b.title, count(p.id) AS sources, coalesce(sum(p.question_count), 0) AS questions FROM {shared_banks} b JOIN {closure} c ON c.ancestor = b.source_deck_id JOIN {pdfs} p ON p.deck_id = c.id GROUP BY b.title",
    "agg37_upper_median": "SELECT id, median AS upper_median FROM {option_lengths}",
    "agg38_confusable": "SELECT topic, JOINED(name, pos) AS concepts FROM (SELECT ITEM(WORDS(category), 0) AS topic, name, min(pos) AS pos FROM {concepts} GROUP BY ITEM(WORDS(category), 0), name) AS x GROUP BY topic",
    "win05_bigrams": "SELECT id, concat(a, ' ', b) AS bigram, count(*) AS n FROM (SELECT id, ITEM(ws, i) AS a, ITEM(ws, i + 1) AS b FROM (SELECT id, ws, EXPLODED(UPTO(0, CAST(SIZE(ws) AS INT) - 2)) AS i FROM (SELECT id, WORDS(" + PLAIN("text") + ") AS ws FROM {chunks}) AS t WHERE SIZE(ws) >= 2) AS u) AS x GROUP BY id, concat(a, ' ', b)",
    "win10_top_per_prefix": "SELECT id, prefix, place FROM {prefixed} WHERE place <= 4",
    "win08_rank_positions": "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS place FROM {bm25} WHERE rank <= 20",
    "srt01_ordered": "SELECT id, CAST(row_number() OVER (ORDER BY page_count DESC, id) AS BIGINT) AS place FROM {pdfs}",
    "srt03_importance_name": "SELECT pdf_id, id, CAST(row_number() OVER (PARTITION BY pdf_id ORDER BY CASE importance WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, lower(name), id) AS BIGINT) AS place FROM {concepts}",
    "srt05_switchable": "SELECT question_id, CAST(row_number() OVER (ORDER BY flags DESC, question_id) AS BIGINT) AS by_flags, CAST(row_number() OVER (ORDER BY n DESC, question_id) AS BIGINT) AS by_attempts FROM (SELECT question_id, count(flag_reason) AS flags, count(*) AS n FROM {attempts} GROUP BY question_id) AS x",
    "srt08_capped": "SELECT pdf_id, id FROM (SELECT pdf_id, id, row_number() OVER (PARTITION BY pdf_id ORDER BY pos) AS place FROM {concepts}) AS x WHERE place <= 8",
    "srt09_newest": "SELECT id, place FROM (SELECT id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS BIGINT) AS place FROM {questions}) AS x WHERE place <= 20",
    "srt10_red_zone": "SELECT id, balance, place FROM (SELECT id, balance, CAST(row_number() OVER (ORDER BY balance, id) AS BIGINT) AS place FROM {pdfs} WHERE balance < 0) AS x",
    "set03_array_union": "SELECT id, TEXTOF(HEAD(UNIQUE(WORDS(concat(o0, ' ', o1, ' ', o3))), 6)) AS words FROM {option_sets}",
    "set06_recursive_union": "SELECT ancestor, count(*) AS members FROM {closure} GROUP BY ancestor",
    "set07_grants": "SELECT p.id FROM {pdfs} p WHERE EXISTS (SELECT 1 FROM {shared_banks} b WHERE b.source_pdf_id = p.id AND b.visibility = 'public') UNION SELECT p.id FROM {pdfs} p JOIN {closure} c ON c.id = p.deck_id JOIN {shared_banks} b ON b.source_deck_id = c.ancestor WHERE b.visibility = 'public'",
    "str03_bm25_tokens": "SELECT id, SIZE(WORDS(SWAP(lower(text), '[^a-z0-9]', ' '))) AS n FROM {chunks}",
    "str08_labels": "SELECT id, trim(SWAP(lower(s), '[^a-z0-9]+', ' ')) AS label FROM {samples}",
    "str09_option_texts": "SELECT id, trim(SWAP(SWAP(SWAP(lower(s), '^[a-e][.)] *', ''), '[^a-z0-9 ]', ' '), ' +', ' ')) AS option_text FROM {samples}",
    "str10_without_label": "SELECT id, trim(SWAP(s, '^ *[A-Ea-e][.)] *', '')) AS bare FROM {samples}",
    "str11_singular": "SELECT word, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN concat(substring(word, 1, length(word) - 3), 'y') WHEN word LIKE '%ses' AND length(word) > 4 THEN substring(word, 1, length(word) - 2) WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN substring(word, 1, length(word) - 1) ELSE word END AS singular FROM (SELECT DISTINCT word FROM (SELECT EXPLODED(WORDS(" + PLAIN("s") + ")) AS word FROM {samples}) AS w) AS x",
    "str14_mentions": "SELECT id, HOLDS(concat(' ', " + PLAIN("s") + ", ' '), ' adh ') AS mentions FROM {samples}",
    "str15_merge_keys": "SELECT id, concat(substring(SWAP(lower(name), '[^a-z0-9]', ''), 1, 30), '|', substring(SWAP(lower(category), '[^a-z]', ''), 1, 10)) AS merge_key FROM {concepts}",
    "str16_prefixes": "SELECT id, lower(CASE WHEN length(ITEM(WORDS(name), 0)) > 4 THEN ITEM(WORDS(name), 0) ELSE TEXTOF(HEAD(WORDS(name), 2)) END) AS prefix FROM {concepts}",
    "str17_slugs": "SELECT id, coalesce(nullif(substring(SWAP(SWAP(trim(lower(s)), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 48), ''), 'bank') AS slug FROM {samples}",
    "str31_overlap": "SELECT a.id, " + R6("CAST(count(DISTINCT a.word) AS DOUBLE) / least(min(a.n), min(b.n))") + " AS overlap FROM (SELECT id, EXPLODED(UNIQUE(WORDS(lower(o1)))) AS word, SIZE(UNIQUE(WORDS(lower(o1)))) AS n FROM {option_sets}) a JOIN (SELECT id, EXPLODED(UNIQUE(WORDS(lower(o3)))) AS word, SIZE(UNIQUE(WORDS(lower(o3)))) AS n FROM {option_sets}) b ON a.id = b.id AND a.word = b.word GROUP BY a.id",
    "str39_answer_index": "SELECT id, CASE WHEN MATCHES(upper(o), '^[A-E]$') THEN ascii(upper(o)) - 65 WHEN MATCHES(o, '^[0-9]+$') THEN CAST(nullif(SWAP(o, '[^0-9]', ''), '') AS INT) ELSE 0 END AS idx FROM {answer_texts}",
    "mth02_cosine_distance": "SELECT query_id, id, " + R6("1 - similarity") + " AS distance FROM {nearest} WHERE place <= 20",
    "mth03_term_weight": "SELECT tf, len, " + R6("tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / 100.0e0))") + " AS weight FROM (SELECT DISTINCT p.tf, l.len FROM {postings} p JOIN {doc_lengths} l ON l.id = p.id) AS x",
    "mth04_reciprocal_rank": "SELECT query_id, id, " + R6("1.0e0 / (60 + place)") + " AS share FROM {nearest} WHERE place <= 8",
    "mth05_money": "SELECT event_id, floor(value * 100 + 0.5e0) / 100 AS usd2, floor(value / 7 * 1000000 + 0.5e0) / 1000000 AS usd6 FROM {events}",
    "mth07_cached_cost": "SELECT event_id, CASE WHEN p.model IS NULL THEN 0.0e0 ELSE " + R6("(greatest(value - 50, 0) * p.input + k * 1.25e0 * p.input + value * 0.1e0 * p.input + k * p.output) / 1000000") + " END AS usd FROM {keyed_events} e LEFT JOIN {prices} p ON p.model = e.event_type",
    "mth10_option_balance": "SELECT id, coalesce(high > 1.6e0 * low, false) OR coalesce(own = high AND own > 1.3e0 * median, false) OR coalesce(own = low AND own < 0.7e0 * median, false) AS unbalanced FROM {option_lengths}",
    "mth11_length_audit": "SELECT id, coalesce(own >= 1.6e0 * others AND own - others >= 2.5e0 AND own >= 5, false) AS tells FROM {option_words}",
    "mth14_eta": "SELECT job_id, seq, CASE WHEN pct > 5 THEN " + ROUND("seq * 100.0e0 / pct - seq") + " END AS eta FROM {process_events}",
    "dat02_next_review": "SELECT user_id, question_id, " + AS_OF + " + CAST(floor(interval_days * 86400000000 + 0.5e0) AS BIGINT) AS next_review FROM {sm2}",
    "qrk09_ease_overflow": "SELECT user_id, question_id, floor(ease * 10000 + 0.5e0) / 10000 AS ease, ease >= 9.99995e0 AS overflows FROM {sm2}",
    "dat04_due": "SELECT user_id, question_id FROM {srs_state} WHERE next_review <= " + AS_OF,
    "arr01_capped_arrays": "SELECT id, SIZE(HEAD(UNIQUE(WORDS(text)), 20)) AS n, TEXTOF(HEAD(UNIQUE(WORDS(text)), 3)) AS head FROM {chunks}",
    "arr02_append": "SELECT id, TEXTOF(PUT(WORDS(name), category)) AS words FROM {concepts}",
    "map01_counts": "SELECT question_id, JOINED(concat(flag_reason, '=', CAST(n AS STRING)), flag_reason) AS counts FROM (SELECT question_id, flag_reason, count(*) AS n FROM {attempts} WHERE flag_reason IS NOT NULL GROUP BY question_id, flag_reason) AS x GROUP BY question_id",
    "jsn03_field": "SELECT event_id, JSONTEXT(props, '$.k') AS k, JSONTEXT(props, '$.criterion') AS criterion FROM {events}",
    "alg11_scope": "SELECT v.user_id, c.ancestor AS scope, v.id, v.origin FROM {visible} v JOIN {pdfs} p ON p.id = v.id JOIN {closure} c ON c.id = p.deck_id",
    "qrk22_half_up": "SELECT event_id, x, " + ROUND("x") + " AS rounded FROM (SELECT event_id, (event_id % 41 - 20) / 2.0e0 AS x FROM {events}) AS e",
}

PLANS = {name: Plan(sql, FIXTURES) for name, sql in SQL.items()}
