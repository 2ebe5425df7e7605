"""The study-content tables, derived from the star schema and text tables at hand, in shared SQL (see plans.plan)."""

from __future__ import annotations

#: Users come in groups of 50, each with a bank of 100 items in ten documents of its own, so that items, documents and
#: concepts grow in number with the users. PDF_OF is a marker of plans.plan.

#: The instant that stands for "now" wherever a rule compares with it.
AS_OF = "MICROS(TIMESTAMP '2024-01-08 00:00:00')"

FIXTURES = {
    "keyed_events": "SELECT *, CAST(JSONTEXT(props, '$.k') AS BIGINT) + 100 * CAST(floor(user_id / 50) AS BIGINT) AS k, MICROS(ts) AS at_us FROM {events}",
    "attempts": """
        SELECT event_id AS id, k AS question_id, user_id, PDF_OF(k) AS pdf_id, CAST(event_id % 6 AS INT) - 1 AS selected_option,
          event_type IN ('click', 'purchase') AS is_correct, CAST(floor(value * 1000 + 0.5e0) AS BIGINT) AS time_spent_ms,
          CASE event_type WHEN 'signup' THEN true WHEN 'view' THEN false END AS explanation_helpful,
          CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'wrong_answer' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'off_topic' ELSE 'other' END END AS flag_reason,
          at_us AS created_at
        FROM {keyed_events}""",
    "questions": """
        SELECT id, pdf_id, CAST(k % 3 AS INT) + 1 AS level, k % 20 + 20 * CAST(floor(k / 100) AS BIGINT) AS concept_id, CAST(CASE WHEN k % 3 = 0 THEN 5 ELSE 4 END AS BIGINT) AS n_options,
          k % 4 AS answer, CAST(floor(pdf_id / 10) AS BIGINT) + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS user_id, k % 17 = 0 AS flagged, k * 1000 AS created_at, concat('Stem of item ', CAST(id AS STRING)) AS stem
        FROM (SELECT k AS id, k, PDF_OF(k) AS pdf_id FROM (SELECT DISTINCT k FROM {keyed_events}) AS a UNION ALL SELECT k + 1000000000, k, PDF_OF(k) FROM (SELECT DISTINCT k FROM {keyed_events} WHERE k % 100 < 10) AS b) AS x""",
    "reviews": """
        SELECT event_id AS id, user_id, k AS question_id, PDF_OF(k) AS pdf_id, CAST(event_id % 4 AS INT) + 1 AS quality, at_us AS reviewed_at,
          row_number() OVER (PARTITION BY user_id, k ORDER BY at_us, event_id) AS turn
        FROM {keyed_events}""",
    "srs_state": """
        SELECT user_id, question_id, pdf_id, max(turn) AS times_reviewed, sum(CASE WHEN quality >= 2 THEN 1 ELSE 0 END) AS times_correct, max(reviewed_at) AS last_reviewed,
          max(reviewed_at) + max(turn) * 86400000000 * 2 AS next_review, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) > 0 AS lapsed
        FROM {reviews} GROUP BY user_id, question_id, pdf_id""",
    "pdf_jobs": """
        SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 77 = 0 THEN NULL ELSE c_mktsegment END AS plan_name,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'processing' END AS status,
          CASE WHEN o_orderstatus <> 'O' THEN MICROS(o_orderdate) END AS finished_at, CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice * 10 + 0.5e0) / 1000000 END AS cost_usd
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "decks": """
        SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name, CAST(r_regionkey AS BIGINT) AS position, r_regionkey = 1 AS is_exam_block, CASE WHEN r_regionkey = 1 THEN 20000 END AS due_day, CAST(0 AS BIGINT) AS user_id FROM {region}
        UNION ALL
        SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, CAST(n_nationkey % 3 AS BIGINT), n_nationkey % 4 = 0, CASE WHEN n_nationkey % 4 = 0 THEN 19000 + n_nationkey END, CAST(0 AS BIGINT) FROM {nation}
        UNION ALL
        SELECT concat('n', CAST(c_nationkey AS STRING), '-', c_mktsegment), concat('n', CAST(c_nationkey AS STRING)), c_mktsegment, CAST(length(c_mktsegment) AS BIGINT), false, CAST(NULL AS INT), CAST(0 AS BIGINT)
        FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}) AS x""",
    "pdfs": """
        SELECT c_custkey AS id, CAST(floor(c_custkey / 10) AS BIGINT) AS user_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('n', CAST(c_nationkey AS STRING), '-', c_mktsegment) END AS deck_id,
          concat(c_name, CASE c_custkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '' END) AS name, CASE WHEN c_custkey % 5 = 0 THEN concat('Chapter ', CAST(c_custkey AS STRING)) END AS display_name,
          CAST(c_custkey % 40 + 1 AS BIGINT) AS page_count, CAST(c_custkey % 90 AS BIGINT) AS question_count, c_custkey % 4 <> 0 AS processed, c_acctbal AS balance
        FROM {customer}""",
    "shared_banks": """
        SELECT s_suppkey AS id, s_suppkey AS owner_user_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS source_pdf_id,
          CASE WHEN s_suppkey % 2 = 1 THEN concat('n', CAST(s_nationkey AS STRING)) END AS source_deck_id, s_name AS title, lower(s_name) AS slug,
          CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'link' END AS visibility, s_suppkey % 7 <> 0 AS is_active
        FROM {supplier}""",
    "members": "SELECT DISTINCT CAST(floor(o_custkey / 10) AS BIGINT) AS user_id, s_suppkey AS shared_bank_id FROM {orders} JOIN {supplier} ON o_orderkey % 9973 = s_suppkey",
    "closure": """
        WITH RECURSIVE up(id, ancestor, depth, path) AS (
          SELECT id, id, CAST(0 AS BIGINT), ONE(id) FROM {decks}
          UNION ALL
          SELECT u.id, d.parent_id, u.depth + 1, PUT(u.path, d.parent_id) FROM up u JOIN {decks} d ON u.ancestor = d.id WHERE d.parent_id IS NOT NULL AND NOT HAS(u.path, d.parent_id))
        SELECT id, ancestor, depth FROM up""",
    "deck_paths": """
        WITH RECURSIVE down(id, path, depth) AS (
          SELECT id, concat(CAST(1000000 + position AS STRING), name), CAST(0 AS BIGINT) FROM {decks} WHERE parent_id IS NULL
          UNION ALL
          SELECT d.id, concat(w.path, '/', CAST(1000000 + d.position AS STRING), d.name), w.depth + 1 FROM down w JOIN {decks} d ON d.parent_id = w.id WHERE w.depth < 50)
        SELECT id, path FROM down""",
    "origins": """
        SELECT user_id, id, '1 owned' AS kind FROM {pdfs}
        UNION ALL SELECT m.user_id, b.source_pdf_id, '2 pdf share' FROM {shared_banks} b JOIN {members} m ON m.shared_bank_id = b.id WHERE b.is_active AND b.source_pdf_id IS NOT NULL
        UNION ALL SELECT m.user_id, p.id, '3 deck share' FROM {shared_banks} b JOIN {members} m ON m.shared_bank_id = b.id JOIN {closure} c ON c.ancestor = b.source_deck_id JOIN {pdfs} p ON p.deck_id = c.id WHERE b.is_active""",
    "grants": "SELECT DISTINCT id AS pdf_id, user_id FROM {origins}",
    "prices": "SELECT 'view' AS model, 0.15e0 AS input, 0.6e0 AS output FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'click', 2.5e0, 10.0e0 FROM {region} WHERE r_regionkey = 0",
    "chunks": "SELECT doc_id AS id, doc_id % 10 AS pdf_id, text FROM {documents}",
    "tokens": "SELECT id, pdf_id, pos, token FROM (SELECT id, pdf_id, EXPLODED(WORDS(SWAP(lower(text), '[^a-z0-9]', ' '))) AS token, CAST(0 AS BIGINT) AS pos FROM {chunks}) AS x",
    "doc_lengths": "SELECT c.id, c.pdf_id, coalesce(t.n, 0) AS len FROM {chunks} c LEFT JOIN (SELECT id, count(*) AS n FROM {tokens} GROUP BY id) t ON c.id = t.id",
    "postings": "SELECT id, token, count(*) AS tf FROM {tokens} GROUP BY id, token",
    "idf": """
        SELECT token, df, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) AS idf
        FROM (SELECT token, count(*) AS df FROM {postings} GROUP BY token) AS d CROSS JOIN (SELECT count(*) AS n FROM {chunks}) AS c""",
    "queries": "SELECT item_id AS query_id, text FROM {benchmark}",
    "query_terms": "SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, EXPLODED(WORDS(SWAP(lower(text), '[^a-z0-9]', ' '))) AS token FROM {queries}) AS x GROUP BY query_id, token",
    "bm25": """
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
          SELECT a.query_id, a.id, coalesce(s.score, 0.0e0) AS score FROM (SELECT q.query_id, l.id FROM {queries} q CROSS JOIN {doc_lengths} l) a LEFT JOIN (
          SELECT q.query_id, p.id, floor(sum(q.qtf * i.idf * p.tf * 2.5e0 / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * l.len / s.mean_len))) * 1e6 + 0.5e0) / 1e6 AS score
          FROM {query_terms} q JOIN {postings} p ON q.token = p.token JOIN {idf} i ON i.token = p.token JOIN {doc_lengths} l ON l.id = p.id
          CROSS JOIN (SELECT CAST(sum(len) AS DOUBLE) / greatest(count(*), 1) AS mean_len FROM {doc_lengths}) s
          GROUP BY q.query_id, p.id) s ON s.query_id = a.query_id AND s.id = a.id) AS x""",
    "concepts": """
        SELECT p_partkey AS id, p_name AS name, p_type AS category, CASE WHEN p_size > 33 THEN 'high' WHEN p_size > 16 THEN 'medium' ELSE 'low' END AS importance, CAST(floor(p_partkey / 50) AS BIGINT) AS pdf_id, p_partkey AS pos, p_brand AS fact
        FROM {part}""",
    "level_scores": """
        SELECT q.concept_id, s.user_id, q.level, sum(s.times_reviewed) AS reviewed, sum(s.times_correct) AS correct
        FROM {questions} q JOIN {srs_state} s ON s.question_id = q.id GROUP BY q.concept_id, s.user_id, q.level""",
    "mastery": """
        SELECT user_id, concept_id, l1, l2, l3, CAST(floor((0.25e0 * l1 + 0.40e0 * l2 + 0.35e0 * l3) + 0.5e0) AS BIGINT) AS overall FROM (
          SELECT user_id, concept_id,
            max(CASE WHEN level = 1 THEN score ELSE 0 END) AS l1, max(CASE WHEN level = 2 THEN score ELSE 0 END) AS l2, max(CASE WHEN level = 3 THEN score ELSE 0 END) AS l3
          FROM (SELECT *, least(100, CAST(floor(100.0e0 * correct / reviewed + 0.5e0) AS BIGINT)) AS score FROM {level_scores}) AS a GROUP BY user_id, concept_id) AS b""",
    "process_events": "SELECT conv_id AS job_id, turn AS seq, least(100, turn * 15) AS pct, role AS phase, CAST(length(text) % 3 AS BIGINT) AS metric FROM {conversations}",
    "ranked_users": """
        SELECT pdf_id, user_id, down <= cutoff AS top, up <= cutoff AS bottom FROM (
          SELECT pdf_id, user_id, row_number() OVER (PARTITION BY pdf_id ORDER BY pct DESC, user_id) AS down, row_number() OVER (PARTITION BY pdf_id ORDER BY pct, user_id DESC) AS up,
            greatest(1, CAST(ceil(0.27e0 * count(*) OVER (PARTITION BY pdf_id)) AS BIGINT)) AS cutoff
          FROM (SELECT pdf_id, user_id, avg(CASE WHEN is_correct THEN 1.0e0 ELSE 0.0e0 END) AS pct FROM {attempts} GROUP BY pdf_id, user_id) AS p) AS x""",
    "vectors": "SELECT vec_id AS id, label AS pdf_id, embedding, DOT(embedding, embedding) AS square FROM {embeddings}",
    "nearest": """
        SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM (
          SELECT q.id AS query_id, v.id, CASE WHEN q.square = 0 OR v.square = 0 THEN 0.0e0 ELSE floor(DOT(q.embedding, v.embedding) / sqrt(q.square * v.square) * 1e6 + 0.5e0) / 1e6 END AS similarity
          FROM (SELECT * FROM {vectors} WHERE id % 100 = 0 OR id IN (SELECT item_id FROM {benchmark})) q JOIN {vectors} v ON v.id <> q.id) AS x""",
    "fused": """
        SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense DESC, id) AS BIGINT) AS place FROM (
          SELECT query_id, id, floor(sum(1.0e0 / (60 + place)) * 1e9 + 0.5e0) / 1e9 AS score, max(dense) AS dense FROM (
            SELECT query_id, id, place, 1 AS dense FROM {nearest} WHERE place <= 8
            UNION ALL SELECT query_id, id, rank, 0 FROM {bm25} WHERE rank <= 8) AS u GROUP BY query_id, id) AS x""",
    "sm2": """
        WITH RECURSIVE fold(user_id, question_id, turns, interval_days, ease, repetitions) AS (
          SELECT user_id, question_id, CAST(0 AS BIGINT), 0.17e0, 2.5e0, CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id, question_id FROM {reviews}) AS k
          UNION ALL
          SELECT f.user_id, f.question_id, f.turns + 1,
            CASE WHEN r.quality <= 1 THEN 0.17e0 WHEN f.repetitions = 0 THEN 1.0e0 WHEN f.repetitions = 1 THEN 2.0e0 ELSE CAST(floor(f.interval_days * f.ease + 0.5e0) AS DOUBLE) END,
            CASE WHEN r.quality >= 3 AND f.repetitions = 0 AND f.turns > 1 THEN least(2.5e0, greatest(1.3e0, f.ease + 0.1e0 - (4 - r.quality) * (0.08e0 + (4 - r.quality) * 0.02e0)) + 0.15e0)
              ELSE greatest(1.3e0, f.ease + 0.1e0 - (4 - r.quality) * (0.08e0 + (4 - r.quality) * 0.02e0)) END,
            CASE WHEN r.quality <= 1 THEN CAST(0 AS BIGINT) ELSE f.repetitions + 1 END
          FROM fold f JOIN {reviews} r ON r.user_id = f.user_id AND r.question_id = f.question_id AND r.turn = f.turns + 1)
        SELECT f.* FROM fold f JOIN (SELECT user_id, question_id, count(*) AS n FROM {reviews} GROUP BY user_id, question_id) n ON n.user_id = f.user_id AND n.question_id = f.question_id AND n.n = f.turns""",
    "prints": "SELECT id, HEAD(WORDS(SWAP(lower(text), '[^a-z0-9]', ' ')), 12) AS toks FROM {chunks}",
    "print_tokens": "SELECT id, token, count(*) AS n FROM (SELECT id, EXPLODED(toks) AS token FROM {prints}) AS x GROUP BY id, token",
    "candidate_pairs": """
        SELECT a.id AS i, b.id AS j, 1 AS same, 0 AS shared FROM {prints} a JOIN {prints} b ON TEXTOF(a.toks) = TEXTOF(b.toks) AND a.id < b.id
        UNION ALL
        SELECT i, j, 0, shared FROM (SELECT a.id AS i, b.id AS j, sum(a.n) AS shared FROM {print_tokens} a JOIN {print_tokens} b ON a.token = b.token AND a.id < b.id GROUP BY a.id, b.id) AS s WHERE shared >= 6""",
}
