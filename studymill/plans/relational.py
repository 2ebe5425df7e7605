"""Relational queries by operator id: scans, filters, joins, aggregates, windows, sets, hierarchies, access, money."""

from __future__ import annotations

from studymill.sources.fixtures import AS_OF, FIXTURES

from .plan import Plan

#: A rate of true values, as in avg(CASE ...).
RATE = "avg(CASE WHEN {0} THEN 1.0e0 ELSE 0.0e0 END)".format
#: Half up, towards plus infinity, as in scripts that round with floor(x + 0.5).
ROUND = "CAST(floor({0} + 0.5e0) AS BIGINT)".format
R6 = "floor(({0}) * 1000000 + 0.5e0) / 1000000".format

SQL = {
    # 2.1 scans and sinks
    "src01_scan": "SELECT id, pdf_id, question_id, user_id, is_correct, created_at FROM {attempts}",
    "src08_plan_changes": "SELECT user_id, plan FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'free' WHEN k % 3 = 0 THEN 'student' WHEN k % 3 = 1 THEN 'boards' ELSE 'institution' END AS plan, row_number() OVER (PARTITION BY user_id ORDER BY at_us DESC, event_id DESC) AS newest FROM {keyed_events} WHERE event_type IN ('purchase', 'error')) AS x WHERE newest = 1",
    "src11_presample": "SELECT pdf_id, pages, words, CAST(floor(words * pages + 0.5e0) AS BIGINT) AS estimated_words FROM (SELECT pdf_id, count(*) AS pages, " + R6("avg(CASE WHEN page <= 3 THEN CAST(n AS DOUBLE) END)") + " AS words FROM (SELECT CAST(floor(doc_id / 40) AS BIGINT) AS pdf_id, row_number() OVER (PARTITION BY CAST(floor(doc_id / 40) AS BIGINT) ORDER BY doc_id) AS page, SIZE(WORDS(text)) AS n FROM {documents}) AS p GROUP BY pdf_id) AS x",
    "snk02_upsert": "SELECT user_id, question_id, quality, reviewed_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY reviewed_at DESC, id DESC) AS newest FROM {reviews}) AS x WHERE newest = 1",
    "snk03_patch": "SELECT id, CASE WHEN deck_id IS NULL THEN 'inbox' ELSE deck_id END AS deck_id, CASE WHEN id % 9 = 0 THEN NULL ELSE display_name END AS display_name FROM {pdfs}",
    "snk04_delete_cascade": "SELECT a.id, a.question_id FROM {attempts} a WHERE NOT EXISTS (SELECT 1 FROM {questions} q WHERE q.id = a.question_id AND q.flagged)",
    "snk04_delete_set_null": "SELECT p.id, CASE WHEN g.id IS NULL THEN p.deck_id END AS deck_id FROM {pdfs} p LEFT JOIN (SELECT id FROM {decks} WHERE parent_id = 'n3') g ON g.id = p.deck_id",
    "snk09_pending_migrations": "SELECT p_partkey AS file FROM {part} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_linenumber = 1)",
    "snk10_owner_rows": "SELECT shared_bank_id, user_id, min(role) AS role FROM (SELECT id AS shared_bank_id, owner_user_id AS user_id, 'a_owner' AS role FROM {shared_banks} UNION ALL SELECT shared_bank_id, user_id, 'member' FROM {members}) AS x GROUP BY shared_bank_id, user_id",
    # 2.2 projections and filters
    "prj02_flatten": "SELECT q.id, q.level, c.name AS concept_name FROM {questions} q LEFT JOIN {concepts} c ON c.id = q.concept_id",
    "prj03_display_name": "SELECT id, CASE WHEN display_name IS NOT NULL THEN display_name ELSE SWAP(name, '[.][pP][dD][fF]$', '') END AS title FROM {pdfs}",
    "prj04_answer_text": "SELECT id, coalesce(ITEM(options, answer), '') AS answer_text FROM (SELECT id, answer + id % 3 AS answer, WORDS(concat('alpha beta gamma delta', CASE WHEN n_options = 5 THEN ' epsilon' ELSE '' END)) AS options FROM {questions}) AS x",
    "prj05_owned_shared": "SELECT g.user_id, p.id, p.user_id = g.user_id AS owned, CASE WHEN p.user_id = g.user_id THEN 'owner' ELSE 'shared' END AS access FROM {grants} g JOIN {pdfs} p ON p.id = g.pdf_id",
    "fil03_null_checks": "SELECT id FROM {pdfs} WHERE deck_id IS NULL AND display_name IS NOT NULL",
    "fil04_contains": "SELECT user_id, question_id FROM {reviews} GROUP BY user_id, question_id HAVING sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) > 0",
    "fil05_ilike": "SELECT id, name FROM {pdfs} WHERE name ILIKE '%00012%.pdf'",
    "fil06_search": "SELECT id, name FROM {pdfs} WHERE HOLDS(lower(name), lower('Customer#00000001'))",
    "fil08_status": "SELECT 'all' AS status, count(*) AS n FROM {pdfs} UNION ALL SELECT 'processed', count(*) FROM {pdfs} WHERE processed UNION ALL SELECT 'unfiled', count(*) FROM {pdfs} WHERE deck_id IS NULL",
    "fil09_exists": "SELECT id, EXISTS (SELECT 1 FROM {concepts} c WHERE c.pdf_id = p.id) AS has_concepts FROM {pdfs} p",
    "fil10_check_violations": "SELECT id, CASE WHEN source_pdf_id IS NULL AND source_deck_id IS NULL THEN 'no source' WHEN source_pdf_id IS NOT NULL AND source_deck_id IS NOT NULL THEN 'two sources' WHEN visibility NOT IN ('private', 'public') THEN 'visibility' END AS violation FROM {shared_banks} WHERE (source_pdf_id IS NULL) = (source_deck_id IS NULL) OR visibility NOT IN ('private', 'public')",
    "fil12_path_owner": "SELECT id FROM (SELECT id, concat(CAST(user_id AS STRING), '/', name) AS path FROM {pdfs}) AS x WHERE ITEM(WORDS(SWAP(path, '/', ' ')), 0) = '7'",
    "fil16_request_split": "SELECT id, CASE WHEN selected_option < 0 THEN 'bad option' WHEN time_spent_ms > 300000 THEN 'bad time' END AS problem FROM {attempts}",
    # 2.3 joins
    "joi01_inner": "SELECT q.id, p.name FROM {questions} q JOIN {pdfs} p ON p.id = q.pdf_id",
    "joi02_lapsed": "SELECT s.user_id, q.id AS question_id, p.name FROM {srs_state} s JOIN {questions} q ON q.id = s.question_id JOIN {pdfs} p ON p.id = q.pdf_id WHERE s.lapsed",
    "joi03_left": "SELECT m.user_id, m.shared_bank_id, b.title FROM {members} m LEFT JOIN {shared_banks} b ON b.id = m.shared_bank_id AND b.is_active",
    "joi04_questions_srs": "SELECT q.id, s.user_id, coalesce(s.times_reviewed, 0) AS times_reviewed, s.next_review FROM {questions} q LEFT JOIN {srs_state} s ON s.question_id = q.id",
    "joi06_semi": "SELECT id, question_id FROM {attempts} a WHERE EXISTS (SELECT 1 FROM {questions} q WHERE q.id = a.question_id AND NOT q.flagged)",
    "joi07_composite_semi": "SELECT id FROM {questions} q WHERE EXISTS (SELECT 1 FROM {pdfs} p WHERE p.id = q.pdf_id AND p.user_id = q.user_id)",
    "joi09_anti_priority": "SELECT user_id, id, min(kind) AS kind FROM {origins} GROUP BY user_id, id",
    "joi10_grants": "SELECT pdf_id, user_id FROM {grants}",
    "joi11_first_public_bank": "SELECT pdf_id, min(bank_id) AS bank_id FROM (SELECT source_pdf_id AS pdf_id, id AS bank_id FROM {shared_banks} WHERE is_active AND visibility = 'public' AND source_pdf_id IS NOT NULL UNION ALL SELECT p.id, b.id FROM {shared_banks} b JOIN {closure} c ON c.ancestor = b.source_deck_id JOIN {pdfs} p ON p.deck_id = c.id WHERE b.is_active AND b.visibility = 'public') AS x GROUP BY pdf_id",
    "joi12_array_membership": "SELECT c.id AS concept_id, d.id AS chunk_id FROM (SELECT id, EXPLODED(UPTO(id * 2, id * 2 + 2)) AS chunk FROM {concepts}) AS c JOIN {chunks} d ON d.id = c.chunk",
    "joi16_name_containment": "SELECT a.id AS i, b.id AS j FROM (SELECT x.category, x.name AS m, y.name AS n FROM (SELECT DISTINCT category, name FROM {concepts}) x JOIN (SELECT DISTINCT category, name FROM {concepts}) y ON x.category = y.category WHERE least(length(x.name), length(y.name)) >= 4 AND (HOLDS(x.name, y.name) OR HOLDS(y.name, x.name))) p JOIN {concepts} a ON a.category = p.category AND a.name = p.m JOIN {concepts} b ON b.category = p.category AND b.name = p.n AND a.id < b.id",
    "joi17_nearest_topic": "SELECT id, topic, distance FROM (SELECT c.id, t.r_name AS topic, CAST(DISTANCE(upper(c.category), t.r_name) AS BIGINT) AS distance, row_number() OVER (PARTITION BY c.id ORDER BY DISTANCE(upper(c.category), t.r_name), t.r_regionkey) AS best FROM {concepts} c CROSS JOIN {region} t) AS x WHERE best = 1 AND distance <= 5",
    "joi19_category_peers": "SELECT id, peers FROM (SELECT id, count(*) OVER (PARTITION BY category, pdf_id) - 1 AS peers FROM {concepts}) AS x WHERE peers > 0",
    "joi20_sibling": """
        SELECT user_id, id, CASE WHEN first_id = id THEN second_id ELSE first_id END AS sibling FROM (SELECT user_id, id, max(CASE WHEN place = 1 THEN id END) OVER (PARTITION BY user_id, concept_id) AS first_id, max(CASE WHEN place = 2 THEN id END) OVER (PARTITION BY user_id, concept_id) AS second_id FROM (
          SELECT u.user_id, q.id, q.concept_id, row_number() OVER (PARTITION BY u.user_id, q.concept_id ORDER BY coalesce(s.last_reviewed, 0), q.id) AS place
          FROM (SELECT DISTINCT s.user_id, q.concept_id FROM {srs_state} s JOIN {questions} q ON q.id = s.question_id) u JOIN {questions} q ON q.concept_id = u.concept_id
          LEFT JOIN {srs_state} s ON s.question_id = q.id AND s.user_id = u.user_id) AS r) AS x WHERE second_id IS NOT NULL""",
    "joi22_dimension_lookup": "SELECT m.user_id, m.concept_id, coalesce(c.importance, 'low') AS importance, m.overall FROM {mastery} m LEFT JOIN (SELECT id, importance FROM {concepts} WHERE importance <> 'medium') c ON c.id = m.concept_id",
    "joi25_scenarios": "SELECT r_name AS tier, price, pdfs, " + R6("price - pdfs * 6.4e0") + " AS margin FROM {region} CROSS JOIN (SELECT DISTINCT CAST(p_size AS DOUBLE) * 10 AS price FROM {part}) a CROSS JOIN (SELECT DISTINCT CAST(p_size AS BIGINT) AS pdfs FROM {part}) b",
    "joi23_chapter_metrics": "SELECT p.id, coalesce(m.l1, 0) AS l1, coalesce(m.l2, 0) AS l2, coalesce(m.l3, 0) AS l3 FROM {pdfs} p LEFT JOIN (SELECT pdf_id, count(CASE WHEN level = 1 THEN 1 END) AS l1, count(CASE WHEN level = 2 THEN 1 END) AS l2, count(CASE WHEN level = 3 THEN 1 END) AS l3 FROM {questions} GROUP BY pdf_id) m ON m.pdf_id = p.id",
    # hierarchies
    "hie01_deck_tree": "SELECT id, depth FROM (SELECT id, max(depth) AS depth FROM {closure} GROUP BY id) AS x",
    "hie02_descendants": "SELECT ancestor AS root, id, depth FROM {closure}",
    "hie03_ancestors": "SELECT id, ancestor, depth FROM {closure}",
    "hie04_exam_deadline": "SELECT id, due_day FROM (SELECT c.id, d.due_day, row_number() OVER (PARTITION BY c.id ORDER BY c.depth) AS nearest FROM {closure} c JOIN {decks} d ON d.id = c.ancestor WHERE d.is_exam_block AND d.due_day IS NOT NULL) AS x WHERE nearest = 1",
    "hie05_subtree_has_pdf": "SELECT DISTINCT c.ancestor AS id, p.id AS pdf_id FROM {closure} c JOIN {pdfs} p ON p.deck_id = c.id",
    "hie06_rollup": "SELECT c.ancestor AS id, sum(n.n) AS pdfs FROM {closure} c JOIN (SELECT deck_id, count(*) AS n FROM {pdfs} WHERE deck_id IS NOT NULL GROUP BY deck_id) n ON n.deck_id = c.id GROUP BY c.ancestor",
    "hie07_source_folder": "SELECT coalesce(c.ancestor, CASE WHEN p.deck_id IS NULL THEN 'Unfiled' ELSE 'Other' END) AS folder, count(*) AS pdfs FROM {pdfs} p LEFT JOIN (SELECT c.id, c.ancestor FROM {closure} c JOIN {decks} d ON d.id = c.ancestor WHERE d.parent_id = 'r1') c ON c.id = p.deck_id GROUP BY coalesce(c.ancestor, CASE WHEN p.deck_id IS NULL THEN 'Unfiled' ELSE 'Other' END)",
    # 2.4 aggregates
    "agg01_difficulty": "SELECT q.id, coalesce(a.rate, 0.0e0) AS difficulty FROM {questions} q LEFT JOIN (SELECT question_id, " + R6(RATE("is_correct")) + " AS rate FROM {attempts} GROUP BY question_id) a ON a.question_id = q.id",
    "agg02_user_percent": "SELECT pdf_id, user_id, " + R6(RATE("is_correct")) + " AS pct, count(*) AS attempts FROM {attempts} GROUP BY pdf_id, user_id",
    "agg04_option_histogram": "SELECT q.id, o.option, count(a.id) AS n FROM (SELECT id, EXPLODED(UPTO(0, CAST(n_options AS INT) - 1)) AS option FROM {questions}) q JOIN (SELECT DISTINCT selected_option AS option FROM {attempts}) o ON o.option = q.option LEFT JOIN {attempts} a ON a.question_id = q.id AND a.selected_option = o.option GROUP BY q.id, o.option",
    "agg03_discrimination": """
        SELECT q.id, """ + R6("coalesce(t.rate, 0.0e0) - coalesce(b.rate, 0.0e0)") + """ AS discrimination FROM {questions} q
        LEFT JOIN (SELECT a.question_id, """ + RATE("a.is_correct") + """ AS rate FROM {attempts} a JOIN {ranked_users} u ON u.pdf_id = a.pdf_id AND u.user_id = a.user_id WHERE u.top GROUP BY a.question_id) t ON t.question_id = q.id
        LEFT JOIN (SELECT a.question_id, """ + RATE("a.is_correct") + """ AS rate FROM {attempts} a JOIN {ranked_users} u ON u.pdf_id = a.pdf_id AND u.user_id = a.user_id WHERE u.bottom GROUP BY a.question_id) b ON b.question_id = q.id""",
    "agg08_item_statistics": """
        SELECT q.id, q.pdf_id, coalesce(s.total, 0) AS attempts, """ + R6("coalesce(s.rate, 0.0e0)") + """ AS difficulty, """ + R6("coalesce(s.top_rate, 0.0e0) - coalesce(s.bottom_rate, 0.0e0)") + """ AS discrimination,
          coalesce(s.avg_time_ms, 0) AS avg_time_ms, coalesce(s.flags, 0) AS flags, s.helpful_pct
        FROM {questions} q LEFT JOIN (
          SELECT a.question_id, count(*) AS total, """ + RATE("a.is_correct") + """ AS rate, avg(CASE WHEN u.top THEN CASE WHEN a.is_correct THEN 1.0e0 ELSE 0.0e0 END END) AS top_rate,
            avg(CASE WHEN u.bottom THEN CASE WHEN a.is_correct THEN 1.0e0 ELSE 0.0e0 END END) AS bottom_rate, """ + ROUND("avg(CAST(a.time_spent_ms AS DOUBLE))") + """ AS avg_time_ms, count(a.flag_reason) AS flags,
            CASE WHEN count(a.explanation_helpful) > 0 THEN """ + ROUND("100.0e0 * count(CASE WHEN a.explanation_helpful THEN 1 END) / nullif(count(a.explanation_helpful), 0)") + """ END AS helpful_pct
          FROM {attempts} a JOIN {ranked_users} u ON u.pdf_id = a.pdf_id AND u.user_id = a.user_id GROUP BY a.question_id) s ON s.question_id = q.id""",
    "win09_top_bottom": "SELECT pdf_id, user_id, top, bottom FROM {ranked_users}",
    "agg06_flag_reasons": "SELECT question_id, flag_reason, count(*) AS n FROM {attempts} WHERE flag_reason IS NOT NULL GROUP BY question_id, flag_reason",
    "agg07_helpful": "SELECT question_id, CASE WHEN count(explanation_helpful) > 0 THEN " + ROUND("100.0e0 * sum(CASE WHEN explanation_helpful THEN 1 ELSE 0 END) / nullif(count(explanation_helpful), 0)") + " END AS helpful_pct FROM {attempts} GROUP BY question_id",
    "agg09_dashboard": """
        SELECT p.id AS pdf_id, coalesce(q.n, 0) AS questions, coalesce(a.attempted, 0) AS attempted, coalesce(a.attempts, 0) AS attempts, coalesce(a.correct, 0) AS correct,
          CASE WHEN a.attempts > 0 THEN """ + ROUND("100.0e0 * a.correct / a.attempts") + """ END AS accuracy, coalesce(q.due, 0) AS due, coalesce(q.fresh, 0) AS fresh, p.processed
        FROM {pdfs} p
        LEFT JOIN (SELECT q.pdf_id, count(*) AS n, count(CASE WHEN s.question_id IS NULL OR s.times_reviewed = 0 THEN 1 END) AS fresh, count(CASE WHEN s.times_reviewed > 0 AND s.next_review <= """ + AS_OF + """ THEN 1 END) AS due
          FROM {questions} q JOIN {pdfs} o ON o.id = q.pdf_id LEFT JOIN {srs_state} s ON s.question_id = q.id AND s.user_id = o.user_id WHERE NOT q.flagged GROUP BY q.pdf_id) q ON q.pdf_id = p.id
        LEFT JOIN (SELECT a.pdf_id, count(DISTINCT a.question_id) AS attempted, count(*) AS attempts, CAST(sum(CASE WHEN a.is_correct THEN 1 ELSE 0 END) AS BIGINT) AS correct
          FROM {attempts} a JOIN {pdfs} o ON o.id = a.pdf_id AND o.user_id = a.user_id WHERE EXISTS (SELECT 1 FROM {questions} q WHERE q.id = a.question_id AND NOT q.flagged) GROUP BY a.pdf_id) a ON a.pdf_id = p.id""",
    "agg10_summary": "SELECT user_id, count(*) AS attempts, count(DISTINCT question_id) AS attempted, count(DISTINCT pdf_id) AS sources, " + ROUND("100.0e0 * avg(CASE WHEN is_correct THEN 1.0e0 ELSE 0.0e0 END)") + " AS accuracy FROM {attempts} GROUP BY user_id",
    "agg11_due_new": "SELECT s.user_id, count(CASE WHEN s.next_review <= " + AS_OF + " THEN 1 END) AS due, max(t.n) - count(*) AS fresh FROM {srs_state} s CROSS JOIN (SELECT count(*) AS n FROM {questions}) t GROUP BY s.user_id",
    "agg13_mastery": "SELECT user_id, concept_id, l1, l2, l3, overall, CASE WHEN overall < 40 THEN 'weak' WHEN overall < 70 THEN 'medium' WHEN overall < 90 THEN 'strong' ELSE 'mastered' END AS status FROM {mastery}",
    "agg15_mastery_summary": "SELECT user_id, count(*) AS studied, count(CASE WHEN overall < 40 THEN 1 END) AS weak, " + ROUND("avg(CAST(overall AS DOUBLE))") + " AS mean_overall FROM {mastery} GROUP BY user_id",
    "agg15_priorities": "SELECT user_id, concept_id, overall, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY overall, concept_id) AS BIGINT) AS place FROM {mastery}) AS x WHERE place <= 10",
    "agg16_cost_summary": """
        SELECT kind, key, jobs, """ + R6("cost") + """ AS cost FROM (
          SELECT 'user' AS kind, CAST(user_id AS STRING) AS key, count(*) AS jobs, sum(coalesce(cost_usd, 0.0e0)) AS cost FROM {pdf_jobs} WHERE finished_at IS NOT NULL GROUP BY user_id
          UNION ALL SELECT 'plan', coalesce(nullif(plan_name, ''), 'unknown'), count(*), sum(coalesce(cost_usd, 0.0e0)) FROM {pdf_jobs} WHERE finished_at IS NOT NULL GROUP BY coalesce(nullif(plan_name, ''), 'unknown')
          UNION ALL SELECT 'mean', 'all', count(*), avg(coalesce(cost_usd, 0.0e0)) FROM {pdf_jobs} WHERE finished_at IS NOT NULL) AS x""",
    "agg17_frequency": "SELECT plan_name, status, count(*) AS n FROM {pdf_jobs} GROUP BY plan_name, status",
    "agg18_acceptance": "SELECT source, floor(1000.0e0 * sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*) + 0.5e0) / 10 AS acceptance_pct FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY source",
    "agg20_rejections": "SELECT coalesce(JSONTEXT(props, '$.criterion'), event_type) AS reason, count(*) AS n FROM {events} WHERE event_type <> 'view' GROUP BY coalesce(JSONTEXT(props, '$.criterion'), event_type)",
    "agg22_runner_metrics": "SELECT count(*) AS generated, CAST(sum(quality) AS BIGINT) AS accepted, CAST(count(*) - sum(quality) AS BIGINT) AS rejected, floor(10000.0e0 * sum(quality) / count(*) + 0.5e0) / 10000 AS acceptance FROM {labels}",
    "agg23_idf": "SELECT token, df, " + R6("idf") + " AS idf FROM {idf}",
    "agg24_term_frequency": "SELECT id, token, tf FROM {postings}",
    "agg26_symmetric_map": "SELECT a, JOINED(b, b) AS peers FROM (SELECT DISTINCT a, b FROM (SELECT name AS a, fact AS b FROM {concepts} WHERE id % 3 = 0 UNION ALL SELECT fact, name FROM {concepts} WHERE id % 3 = 0 UNION ALL SELECT name, category FROM {concepts} WHERE id % 7 = 0 UNION ALL SELECT category, name FROM {concepts} WHERE id % 7 = 0) AS e WHERE a <> b) AS x GROUP BY a",
    "agg28_judge_means": "SELECT event_type, coalesce(" + R6("avg(value)") + ", 0) AS mean_score, count(*) AS n FROM {events} GROUP BY event_type",
    "agg29_text_quality": "SELECT pdf_id, CASE WHEN mean_chars < 1 THEN 'empty' WHEN mean_chars < 100 OR low_ratio > 0.4e0 THEN 'poor' ELSE 'ok' END AS quality, " + R6("low_ratio") + " AS low_ratio FROM (SELECT CAST(floor(doc_id / 40) AS BIGINT) AS pdf_id, avg(CAST(length(text) AS DOUBLE)) AS mean_chars, avg(CASE WHEN length(text) < 50 OR length(ASCIILESS(text)) > 0.15e0 * length(text) THEN 1.0e0 ELSE 0.0e0 END) AS low_ratio FROM {documents} GROUP BY CAST(floor(doc_id / 40) AS BIGINT)) AS x",
    "agg30_bank_preview": """
        SELECT b.id, coalesce(sum(p.question_count), 0) AS questions, coalesce(sum(p.page_count), 0) AS pages, count(p.id) AS sources, max(coalesce(m.n, 0)) AS members FROM {shared_banks} b
        LEFT JOIN (SELECT id AS bank, source_pdf_id AS pdf FROM {shared_banks} WHERE source_pdf_id IS NOT NULL UNION SELECT s.id, p.id FROM {shared_banks} s JOIN {closure} c ON c.ancestor = s.source_deck_id JOIN {pdfs} p ON p.deck_id = c.id) x ON x.bank = b.id
        LEFT JOIN {pdfs} p ON p.id = x.pdf LEFT JOIN (SELECT shared_bank_id, count(*) AS n FROM {members} GROUP BY shared_bank_id) m ON m.shared_bank_id = b.id GROUP BY b.id""",
    "agg31_pdfs_per_deck": "SELECT deck_id, count(*) AS n FROM {pdfs} WHERE deck_id IS NOT NULL GROUP BY deck_id",
    "agg33_concepts_by_category": "SELECT category, count(*) AS n, count(CASE WHEN importance = 'high' THEN 1 END) AS high FROM {concepts} GROUP BY category",
    "agg34_mode": "SELECT category, fact FROM (SELECT category, fact, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, min(pos)) AS best FROM {concepts} GROUP BY category, fact) AS x WHERE best = 1",
    "agg36_median": "SELECT event_type, " + R6("median(value)") + " AS median_value FROM {events} GROUP BY event_type",
    "agg39_last_metric": "SELECT job_id, metric FROM (SELECT job_id, metric, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS newest FROM {process_events} WHERE metric <> 0) AS x WHERE newest = 1",
    "agg40_running_cost": "SELECT id, floor(sum(coalesce(cost_usd, 0.0e0)) OVER (PARTITION BY user_id ORDER BY id) * 10000 + 0.5e0) / 10000 AS cost FROM {pdf_jobs}",
    "agg41_extra_multiples": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY concept_id, level ORDER BY id) AS place FROM {questions}) AS x WHERE place > 1",
    "agg42_level_counts": "SELECT pdf_id, count(CASE WHEN level = 1 THEN 1 END) AS l1, count(CASE WHEN level = 2 THEN 1 END) AS l2, count(CASE WHEN level = 3 THEN 1 END) AS l3 FROM {questions} GROUP BY pdf_id",
    "agg43_session_score": "SELECT user_id, count(*) AS revealed, count(CASE WHEN is_correct THEN 1 END) AS correct, count(CASE WHEN NOT is_correct THEN 1 END) AS missed, " + ROUND("100.0e0 * count(CASE WHEN is_correct THEN 1 END) / count(*)") + " AS percent FROM {attempts} WHERE selected_option >= 0 GROUP BY user_id",
    # 2.5 windows
    "win11_first_seen": "SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY pos) AS place FROM {concepts}) AS x WHERE place = 1",
    "win12_slots": """
        SELECT pdf_id, id, n_levels, running FROM (
          SELECT pdf_id, id, n_levels, CAST(sum(n_levels) OVER (PARTITION BY pdf_id ORDER BY pos) AS BIGINT) AS running, row_number() OVER (PARTITION BY pdf_id ORDER BY pos) AS place
          FROM (SELECT *, CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS n_levels FROM {concepts}) AS c) AS x WHERE running <= 30 OR place = 1""",
    "win13_merged_intervals": """
        SELECT user_id, min(a) AS a, max(b) AS b FROM (
          SELECT user_id, a, b, sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
            SELECT id, user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM (SELECT id, user_id, time_spent_ms AS a, time_spent_ms + 400 + id % 900 AS b FROM {attempts}) AS s) AS r) AS x GROUP BY user_id, island""",
    "win19_next_position": "SELECT d.id, coalesce(max(c.position) + 1, 0) AS next_position FROM {decks} d LEFT JOIN {decks} c ON c.parent_id = d.id GROUP BY d.id",
    "win20_deck_rank": "SELECT p.id, r.rank FROM {pdfs} p LEFT JOIN (SELECT id, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS rank FROM {deck_paths}) r ON r.id = p.deck_id",
    "win22_apportion": """
        SELECT pdf_id, id, whole + CASE WHEN place <= 40 - given THEN 1 ELSE 0 END AS target FROM (
          SELECT pdf_id, id, whole, sum(whole) OVER (PARTITION BY pdf_id) AS given, row_number() OVER (PARTITION BY pdf_id ORDER BY exact - whole DESC, tokens DESC, id) AS place FROM (
            SELECT pdf_id, id, tokens, exact, CAST(floor(exact) AS BIGINT) AS whole FROM (
              SELECT pdf_id, id, tokens, 40.0e0 * tokens / sum(tokens) OVER (PARTITION BY pdf_id) AS exact FROM (SELECT CAST(floor(doc_id / 40) AS BIGINT) AS pdf_id, doc_id AS id, length(text) AS tokens FROM {documents}) AS d) AS e) AS w) AS x""",
    "alg08_sm2_fold": "SELECT user_id, question_id, turns, floor(interval_days * 10000 + 0.5e0) / 10000 AS interval_days, floor(ease * 10000 + 0.5e0) / 10000 AS ease, repetitions FROM {sm2}",
    "str21_word_count": "SELECT doc_id, SIZE(WORDS(SWAP(text, '[ \\t\\n\\r]+', ' '))) AS words, CAST(ceil(length(text) / 4.0e0) AS BIGINT) AS tokens FROM {documents}",
    "str35_levenshtein": "SELECT p_partkey AS id, CAST(DISTANCE(lower(p_name), lower(p_type)) AS BIGINT) AS distance FROM {part}",
    # 2.6, 2.7 orders and sets
    "srt02_ranked_decks": "SELECT id, CAST(row_number() OVER (ORDER BY depth, position, name, id) AS BIGINT) AS place FROM (SELECT d.id, d.position, d.name, max(c.depth) AS depth FROM {decks} d JOIN {closure} c ON c.id = d.id GROUP BY d.id, d.position, d.name) AS x",
    "srt04_alphabetical_importance": "SELECT pdf_id, id, CAST(row_number() OVER (PARTITION BY pdf_id ORDER BY importance DESC, name, id) AS BIGINT) AS place FROM {concepts}",
    "srt07_top_failures": "SELECT question_id, missed FROM (SELECT question_id, count(*) AS missed, row_number() OVER (ORDER BY count(*) DESC, question_id) AS place FROM {attempts} WHERE NOT is_correct GROUP BY question_id) AS x WHERE place <= 12",
    "set01_flagged_or_lapsed": "SELECT DISTINCT source, question_id FROM (SELECT 'flagged' AS source, id AS question_id FROM {questions} WHERE flagged UNION ALL SELECT 'lapsed', question_id FROM {srs_state} WHERE lapsed) AS x",
    "set02_visible": "SELECT user_id, id, 'owned' AS origin FROM {pdfs} UNION ALL SELECT DISTINCT m.user_id, p.id, 'shared' FROM {members} m JOIN {shared_banks} b ON b.id = m.shared_bank_id AND b.visibility = 'public' JOIN {pdfs} p ON p.id = b.source_pdf_id WHERE p.user_id <> m.user_id",
    "set04_added": "SELECT id FROM {pdfs} WHERE processed EXCEPT SELECT source_pdf_id FROM {shared_banks}",
    # 2.8 arithmetic
    "mth06_token_cost": "SELECT event_id, CASE WHEN p.model IS NULL THEN 0.0e0 ELSE " + R6("(greatest(value - 50, 0) * p.input + k * p.output) / 1000000") + " END AS usd FROM {keyed_events} e LEFT JOIN {prices} p ON p.model = e.event_type",
    "mth08_margins": "SELECT pdfs, price, " + R6("price - cost * pdfs") + " AS margin, " + R6("(price - cost * pdfs) / price * 100") + " AS margin_pct, " + R6("price / cost") + " AS break_even_pdfs, " + R6("price / pdfs") + " AS break_even_cost, " + R6("cost * pdfs / (1 - 0.6e0)") + " AS required_price, CAST(floor(price * (1 - 0.6e0) / cost + 1e-9) AS BIGINT) AS max_pdfs FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS pdfs FROM {part}) a CROSS JOIN (SELECT DISTINCT CAST(c_nationkey AS DOUBLE) * 7 + 9 AS price FROM {customer}) b CROSS JOIN (SELECT 6.4e0 AS cost FROM {region} WHERE r_regionkey = 0) c",
    "mth13_estimates": "SELECT id, q AS target, CAST(floor(q * 0.75e0) AS BIGINT) AS low, CAST(ceil(q * 1.25e0) AS BIGINT) AS high, 5 * q + 10 * page_count + 60 AS seconds FROM (SELECT id, page_count, page_count * 4 AS q FROM {pdfs}) AS x",
    "mth16_level_split": "SELECT id, question_count AS total, CASE WHEN question_count >= 2 THEN greatest(1, " + ROUND("0.45e0 * question_count") + ") ELSE 0 END AS level3 FROM {pdfs}",
    "dat01_days_left": "SELECT user_id, question_id, CAST(ceil((next_review - " + AS_OF + ") / 86400000000.0e0) AS BIGINT) AS days_left FROM {srs_state}",
    "alg09_target_level": "SELECT user_id, concept_id, CASE WHEN l1 < 60 THEN 1 WHEN l2 < 60 THEN 2 WHEN l3 < 60 THEN 3 WHEN l1 <= l2 AND l1 <= l3 THEN 1 WHEN l2 <= l3 THEN 2 ELSE 3 END AS target_level FROM {mastery}",
    # retrieval
    "joi15_bm25": "SELECT query_id, id, score, CAST(rank AS BIGINT) AS rank FROM {bm25} WHERE rank <= 10",
    "alg02_rrf": "SELECT query_id, id, score, place FROM {fused} WHERE place <= 4",
    "alg01_hybrid": "SELECT q.query_id, coalesce(f.id, 0 - 1) AS id, coalesce(f.place, 0) AS place FROM {queries} q LEFT JOIN (SELECT * FROM {fused} WHERE place <= 4) f ON f.query_id = q.query_id",
    "joi14_exact_knn": "SELECT query_id, id, similarity, CAST(place AS BIGINT) AS place FROM {nearest} WHERE place <= 8",
    "mth01_cosine": "SELECT query_id, id, similarity FROM {nearest} WHERE place <= 20 AND similarity > 0.2e0",
    "stm03_latest_state": "SELECT job_id, pct, phase, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS newest FROM {process_events}) AS x WHERE newest = 1",
    "stm07_last_plan": "SELECT user_id, plan_name FROM (SELECT user_id, plan_name, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS newest FROM {pdf_jobs}) AS x WHERE newest = 1",
}

PLANS = {name: Plan(sql, FIXTURES) for name, sql in SQL.items()}
