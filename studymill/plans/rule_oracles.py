"""DuckDB queries for plans.rules, written from the rules and not from its code. Fixtures in braces become common table expressions."""

from __future__ import annotations


def plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def label(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def times(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


def ascii_signs(x: str) -> str:
    return f"translate({x}, '‘’‚‛′‵“”„‟″‶–—―', concat(repeat('''', 6), repeat('\"', 6), '---'))"


STOP = "a an the and or but of to in on for with by at from into during including until against among throughout despite towards upon about over under after before between without within along following across behind beyond plus except up out around down off above near is are was were be been being which what how why when where who whom this that these those his her their its your our best most likely"
EVIDENCE_STOP = "which their there these those because during through between within without about after before under above below other into from that this with have been they them than then"
NOISE = "particles cells cell disease diseases syndrome syndromes disorder disorders condition conditions type types formation occurrence incident event process mechanism therapy treatment development activation dysfunction injury damage response reaction changes change"


def listed(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


def search(x: str) -> str:
    return rf"trim(lower(regexp_replace({ascii_signs(x)}, '\s+', ' ', 'g')))"


def evidence_text(x: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace({ascii_signs(x)}, '\s+', ' ', 'g'), '([.,;:!?])[.,;:!?]+', '\1', 'g')))"


def copied(x: str) -> str:
    return rf"trim(regexp_replace(lower({ascii_signs(rf'''regexp_replace({x}, '([A-Za-z]{{2,}})\s*-\s+([a-z]{{2,}})', '\1\2', 'g')''')}), '[^a-z0-9]+', ' ', 'g'))"


def option_text(x: str) -> str:
    return plain(rf"regexp_replace(lower({x}), '^[a-e][.)]\s*', '')")


def stem_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains({listed(STOP)}, w))"


BOOKS = "TMP13|PBD9|BP9|PBD8|BP8"
TAGGED = rf"""
    SELECT book, page, text, CASE WHEN regexp_matches(text, '(^|\n)\s*ANSWERS\s*(\n|$)') OR (cited >= 5 AND answers >= 3) OR answers >= 6 THEN 'a' WHEN cited < 3 AND (options >= 8 OR asked >= 3) THEN 'q' ELSE 'empty' END AS kind,
      coalesce(nullif(trim(regexp_replace(regexp_extract(text, 'Unit\s+[IVX]+\s+[A-Za-z][A-Za-z ]+'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_extract(text, '(?:^|\n)\s*(?:CHAPTER|C\s*H\s*A\s*P\s*T\s*E\s*R)\s*\d*\s*\n\s*([A-Z][A-Za-z ]{{2,50}}?)\s*(?:\n|$)', 1)), ''), nullif(trim(regexp_extract(text, 'C\s*H\s*A\s*P\s*T\s*E\s*R\s+\d[\d ]*\s+([A-Z][A-Za-z][A-Za-z ]{{2,40}})', 1)), '')) AS unit
    FROM (SELECT *, {times("text", rf"\b({BOOKS})\s+(p\.?\s*)?\d+")} AS cited, {times("text", r"(?:^|\n)\s*\d+\.\s+[A-H]\)\s+[A-Z]")} + {times("text", r"(?:^|\n)\s*\d+\s+[A-H]\s+[A-Z][a-z]")} AS answers,
      {times("text", r"(?:^|\n)\s*[A-H](?:\)|\s)\s*[A-Z]")} AS options, {times("text", r"(?:^|\n)\s*\d+\.\s+[A-Z][a-z]")} + {times("text", r"(?:^|\n)\s*\d+\s+[A-Z](?:[a-z]|\s[a-z]|\s\d|\s[A-Z])")} AS asked FROM {{bank_pages}}) AS x"""
HEADING = r"^\s*(?:[IVXLCDM]+\b[.)-]?|[A-Z][A-Z0-9 ,:;()/-]{5,})\s*$"

SQL = {
    "str36_page_kinds": f"SELECT book, page, kind FROM ({TAGGED}) AS t",
    "str37_units": f"SELECT book, page, unit FROM ({TAGGED}) AS t",
    "win18_sections": f"""
        WITH t AS (SELECT * FROM ({TAGGED}) AS t WHERE kind <> 'empty'),
        s AS (SELECT *, sum(CASE WHEN kind = 'q' AND before = 'a' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page) AS section FROM (SELECT *, lag(kind) OVER (PARTITION BY book ORDER BY page) AS before FROM t) AS x),
        u AS (SELECT book, section, unit, row_number() OVER (PARTITION BY book, section ORDER BY kind DESC, count(*) DESC, min(page)) AS best FROM s WHERE unit IS NOT NULL GROUP BY book, section, kind, unit),
        g AS (SELECT book, section, min(page) FILTER (kind = 'q') AS first_page, count(*) FILTER (kind = 'q') AS q_pages, count(*) FILTER (kind = 'a') AS a_pages FROM s GROUP BY book, section)
        SELECT g.book, first_page, q_pages, a_pages, u.unit FROM g LEFT JOIN u ON u.book = g.book AND u.section = g.section AND best = 1 WHERE q_pages > 0 AND a_pages > 0""",
    "agg35_max_number": r"SELECT id, coalesce(list_max(list_filter(list_transform(regexp_extract_all(text, '(?:^|\n)\s*(\d+)(?:\.\s+[A-H]\)|\s+[A-H]\b)', 1), lambda n: TRY_CAST(n AS BIGINT)), lambda n: n BETWEEN 1 AND 500)), 0) AS last_answer FROM {bank_pages}",
    "win21_ranges": r"""
        WITH l AS (SELECT id, i, line, TRY_CAST(nullif(regexp_extract(line, '^(\d+)(?:\.|[\s\-])', 1), '') AS BIGINT) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {bank_pages}) AS x),
        a AS (SELECT id, min(i) AS a FROM l WHERE n BETWEEN 2 AND 12 GROUP BY id),
        b AS (SELECT l.id, min(i) AS b FROM l JOIN a ON a.id = l.id AND l.i > a.a WHERE n > 12 GROUP BY l.id)
        SELECT p.id, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS lines FROM {bank_pages} p LEFT JOIN (
          SELECT l.* FROM l JOIN a ON a.id = l.id AND l.i >= a.a LEFT JOIN b ON b.id = l.id WHERE (b IS NULL OR i < b) AND (n IS NULL OR n BETWEEN 2 AND 12)) x ON x.id = p.id GROUP BY p.id""",
    "win15_headings": rf"""
        WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {{bank_pages}}),
        s AS (SELECT *, sum(CASE WHEN regexp_matches(trim(line), '{HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS k FROM l),
        g AS (SELECT id, k, {strip("min_by(line, i)")} AS heading, {strip("string_agg(line, chr(10) ORDER BY i)")} AS content FROM s WHERE k > 0 GROUP BY id, k)
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS place, heading, md5(content) AS content FROM g WHERE heading <> '' AND content <> ''""",
    "win16_packing": rf"""
        WITH RECURSIVE t AS (SELECT id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x <> ''), lambda x: greatest(1, CAST(ceil(length(x) / 4.0) AS BIGINT))) AS n FROM {{bank_pages}}),
        w AS (
          SELECT id, n, 0 AS i, 0 AS seg, CAST(0 AS BIGINT) AS tokens, CAST([] AS INT[]) AS parts FROM t
          UNION ALL
          SELECT id, n, i + 1, seg + shut, CASE WHEN shut = 1 THEN n[i + 1] ELSE tokens + n[i + 1] END, list_append(parts, seg + shut) FROM (
            SELECT *, CASE WHEN len(n) > 1 AND tokens > 0 AND seg < 3 AND tokens + n[i + 1] > list_sum(n) / 4.0 * 1.15 THEN 1 ELSE 0 END AS shut FROM w WHERE i < len(n)) AS x)
        SELECT id, array_to_string(parts, ',') AS segments FROM w WHERE i = len(n)""",
    "win17_even_split": rf"""
        WITH RECURSIVE w AS (
          SELECT id, text, 0 AS place, 0 AS a, 0 AS b, CAST(ceil(length(text) / 3.0) AS INT) AS size, 0 AS step FROM {{bank_pages}}
          UNION ALL
          SELECT id, text, CASE WHEN {strip("substring(text, a + 1, e - a)")} = '' THEN place ELSE place + 1 END, a, e, size, step + 1 FROM (
            SELECT *, CASE WHEN place = 2 THEN length(text) ELSE least(length(text), a + size) + coalesce(nullif(length(regexp_extract(substring(text, least(length(text), a + size) + 1, 500), '^((?s:.*?)[.!?])\s', 1)), 0), -1) + 1 END AS e
            FROM (SELECT id, text, place, b AS a, size, step FROM w WHERE b < length(text) AND place < 3 AND step < 6) AS y) AS x)
        SELECT id, CAST(place - 1 AS INT) AS place, a, b FROM w WHERE step > 0 AND {strip("substring(text, a + 1, b - a)")} <> ''""",
    "fil15_front_matter": rf"""
        SELECT id, length(trim(text)) >= 80 AND NOT (regexp_matches(t, '(?i)\b(chapter contents|see targeted therapy available online|vascular structure and function|vascular anomalies|pathology of vascular intervention)\b') AND ({times("t", r"\b\d{3}\s+[A-Z][A-Za-z][^.;]{3,60}")} >= 6 OR {times("t", r"\b\d{3}\b")} >= 10)) AS eligible
        FROM (SELECT id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM {{bank_pages}}) AS x""",
    "srt06_relevance": """
        SELECT id, type, CAST(instr(lower(hay), '1') - 1 - CASE WHEN type = 'action' THEN 50 ELSE 0 END AS BIGINT) AS score FROM (
          SELECT id, 'pdf' AS type, concat_ws(' ', coalesce(display_name, regexp_replace(name, '(?i)[.]pdf$', '')), concat(question_count, ' Q')) AS hay FROM {pdfs} WHERE processed
          UNION ALL SELECT id, 'action', concat('Open chapter 1', id) FROM {pdfs} WHERE id % 7 = 0) AS x WHERE instr(lower(hay), '1') > 0""",
    "joi21_exemplars": """
        SELECT id, exemplar, CAST(k AS BIGINT) AS place FROM (SELECT c.id, e.exemplar, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN e.level = 2 THEN 0 ELSE 1 END, e.exemplar) AS k FROM {concepts} c JOIN {exemplars} e
          ON len(list_filter(string_split(lower(c.name), ' '), lambda w: w <> '' AND contains(e.topic, w))) > 0) AS x WHERE k <= 2""",
    "alg19_distractor_pool": f"""
        WITH c AS (SELECT id, pos, name, category, {label("name")} AS label FROM {{concepts}}),
        p AS (SELECT a.id, b.label, 1 AS source, min(b.pos) AS rank, min_by(b.name, b.pos) AS text FROM c a JOIN c b ON a.category = b.category AND a.label <> b.label AND b.label <> '' GROUP BY a.id, b.label),
        t AS (SELECT f.id, {label("target")} AS label, 2 AS source, n AS rank, target AS text FROM {{confusions}} f JOIN c ON c.id = f.id WHERE {label("target")} <> c.label AND {label("target")} <> ''),
        o AS (SELECT id, label, first(text ORDER BY source, rank) AS text, min(source) AS source, first(rank ORDER BY source, rank) AS rank, max(source) AS most FROM (SELECT * FROM p UNION ALL SELECT * FROM t) AS u GROUP BY id, label),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, rank, label) AS k FROM o)
        SELECT id, CAST(k AS BIGINT) AS place, text, CASE WHEN most = 2 THEN 'confusion_pair' ELSE 'same_category_peer' END AS reason FROM r WHERE k <= 8""",
    "alg07_provenance": rf"""
        SELECT id, chunk, CAST(instr(text, target) - 1 AS BIGINT) AS start, CAST(instr(text, target) - 1 + length(target) AS BIGINT) AS end FROM (
          SELECT q.id, q.target, c.id AS chunk, c.text, row_number() OVER (PARTITION BY q.id ORDER BY c.id) AS k FROM (SELECT id, {strip("quote")} AS target FROM {{drafts}} WHERE quote IS NOT NULL AND length(trim(quote)) > 0) q
          JOIN {{chunks}} c ON contains(c.text, q.target)) AS x WHERE k = 1""",
    "joi24_saved_orders": """
        WITH n AS (SELECT session, list(id) AS own FROM {session_items} GROUP BY session)
        SELECT session, CAST(place - 1 AS BIGINT) AS place, id FROM (SELECT s.session, unnest(s.ids) AS id, generate_subscripts(s.ids, 1) AS place FROM {saved_orders} s JOIN n ON n.session = s.session
          WHERE len(s.ids) = len(own) AND len(list_distinct(s.ids)) = len(own) AND len(list_filter(s.ids, lambda i: NOT list_contains(own, i))) = 0) AS x""",
    "src09_event_blocks": r"""
        SELECT job_id, place, CAST(json_extract(data, '$.phase') AS INT) AS phase, json_extract_string(data, '$.message') AS message, CAST(json_extract(data, '$.pct') AS INT) AS pct FROM (
          SELECT job_id, CAST(i - 1 AS BIGINT) AS place, trim(array_to_string(list_transform(list_filter(string_split(block, chr(10)), lambda l: starts_with(l, 'data:')), lambda l: ltrim(substring(l, 6))), chr(10))) AS data
          FROM (SELECT job_id, unnest(string_split(body, chr(10) || chr(10))) AS block, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i FROM {framed}) AS x) AS y WHERE json_valid(data) AND json_extract(data, '$.phase') IS NOT NULL""",
    "alg30_plan_gate": """
        SELECT user_id, tier, used, CASE tier WHEN 'free' THEN used < 2 WHEN 'student' THEN used < 10 WHEN 'boards' THEN used < 30 ELSE true END AS allowed FROM (
          SELECT user_id, CASE WHEN plan IN ('student', 'boards', 'institution') THEN plan ELSE 'free' END AS tier, CASE WHEN reset_day < DATE '2024-01-01' THEN 0 ELSE CAST(used AS BIGINT) END AS used FROM {profiles}) AS x""",
    "dat03_month_reset": "SELECT user_id, reset_day < DATE '2024-01-01' AS reset FROM {profiles}",
    "set05_shared_tokens": "SELECT id, CAST(len(list_filter(string_split(lower(a), ' '), lambda w: w <> '' AND list_contains(string_split(lower(b), ' '), w))) AS BIGINT) AS shared FROM {option_texts}",
    "str18_free_slugs": """
        SELECT id, CASE WHEN k IS NULL THEN NULL WHEN k = 1 THEN base ELSE concat(base, '-', k) END AS slug FROM (SELECT id, base, list_min(list_filter(generate_series(1, 20), lambda k: NOT list_contains(there, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k) END))) AS k
          FROM {slug_requests} CROSS JOIN (SELECT list(slug) AS there FROM {slugs_there}) AS t) AS x""",
    "str01_stem_tokens": f"SELECT id, CAST(len(t) AS BIGINT) AS n, t[1] AS first_token FROM (SELECT id, {stem_tokens('text')} AS t FROM {{chunks}}) AS x",
    "str02_fingerprints": f"SELECT id, array_to_string(list_slice({stem_tokens('text')}, 1, 12), ' ') AS fingerprint FROM {{chunks}}",
    "str05_evidence_texts": f"SELECT id, md5({evidence_text('x')}) AS evidence_text FROM (SELECT id, concat_ws(' ', quote, source) AS x FROM {{drafts}}) AS d",
    "str06_search_texts": f"SELECT id, md5({search('x')}) AS search_text FROM (SELECT id, concat_ws(' ', quote, source) AS x FROM {{drafts}}) AS d",
    "str07_copy_texts": f"SELECT id, md5({copied('x')}) AS copy_text FROM (SELECT id, concat_ws(' ', a, '- wrapped', source) AS x FROM {{drafts}}) AS d",
    "str19_sentences": rf"""
        WITH s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(source, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: {strip("x")}), lambda x: length(x) >= 30
          AND NOT regexp_matches(x, '^\s*[A-E]\s+\w.{{5,}}\s+[B-E]\s+\w') AND NOT regexp_matches(x, '\bWhich of the following\b.*\?$') AND NOT regexp_matches(x, '\bWhat is the most likely\b.*\?$')) AS ss FROM {{drafts}})
        SELECT id, CAST(len(ss) AS BIGINT) AS n, md5(array_to_string(ss, ' ~ ')) AS sentences FROM s""",
    "str20_embedded": r"""
        SELECT id, regexp_matches(stem, '^\s*[A-E]\s+\w.{5,}\s+[B-E]\s+\w') OR regexp_matches(trim(stem), '\bWhich of the following\b.*\?$') OR regexp_matches(trim(stem), '\bWhat is the most likely\b.*\?$') AS stem,
          regexp_matches(l, '^\s*[A-E]\s+\w.{5,}\s+[B-E]\s+\w') AS listed FROM (SELECT id, stem, concat(CASE WHEN id % 3 = 0 THEN 'A Endothelial disruption B ' ELSE 'It ' END, s0) AS l FROM {drafts}) AS x""",
    "str22_without_tail": rf"""
        WITH o AS (SELECT id, {strip("options[-2]")} AS t, concat(a, ', which rises ', b) AS u FROM {{drafts}}),
        p AS (SELECT id, t, u, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM o)
        SELECT id, CASE WHEN len(parts) > 1 THEN trim(array_to_string(parts[:-2], ' ')) ELSE trim(regexp_replace(regexp_replace(t, '(?is)(?:\s*[,;:]\s*|\s+-\s+|\s+)(?:because|which|allowing|while|since|as|so that)\b.*$', ''), '[\s,;:.-]+$', '')) END AS option,
          trim(regexp_replace(regexp_replace(u, '(?is)(?:\s*[,;:]\s*|\s+-\s+|\s+)(?:because|which|allowing|while|since|as|so that)\b.*$', ''), '[\s,;:.-]+$', '')) AS clause FROM p""",
    "str23_interrogative": rf"""
        SELECT id, trim(stem) <> '' AND (regexp_matches(t, '\?\s*$') OR regexp_matches(trim(regexp_extract(t, '(?s)^(?:.*[.!?]\s+)?(.*)$', 1)), '(?i)^(which|what|how|why|when|where|identify|select the|choose the)\b')) AS interrogative
        FROM (SELECT id, stem, {strip(rf"regexp_replace({strip('stem')}, '(?:\s*\([^)]*\)\s*)+$', '')")} AS t FROM {{drafts}}) AS x""",
    "str24_negation": r"SELECT id, regexp_matches(stem, '(?i)\b(not|except|least)\b') AS negation, regexp_matches(stem, '(?i)^\s*A\s+\d{1,3}-year-old\s+(male|female)\s+present') AS opens_with_case FROM {drafts}",
    "str25_quote_faults": rf"""
        SELECT id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^[-–—a-z]') THEN 'Source quote appears to be a mid-sentence fragment — pick a complete sentence that starts with a capital letter.' WHEN n < 10 THEN 'Source quote must be at least 10 words copied verbatim from the source passages.'
          WHEN n > 35 THEN concat('Source quote is too long (', n, ' words). Pick a single body-text sentence under 35 words that directly proves the keyed answer.') WHEN ends > 1 THEN 'Source quote must be a single sentence from the source passages — do not merge multiple sentences.'
          WHEN ends = 0 AND n < 18 THEN 'Source quote must be a complete sentence ending in a period from the source passages.' WHEN numbers >= 3 AND numbers / n > 0.07 THEN 'Source quote appears to be a table of contents or index page — use a verbatim sentence from the body text.'
          WHEN regexp_matches(t, '\b[A-E]\s+[A-Z][a-z].{{3,}}\s+[B-E]\s+[A-Z]') THEN 'Source quote appears to be a multiple-choice option list, not prose. Pick a single explanatory sentence from the body text.'
          WHEN regexp_matches(t, '\b(Which of the following|What is the most likely)\b.*\?$') THEN 'Source quote must be explanatory prose from the source, not a test question stem.' END AS issue
        FROM (SELECT id, t, len({words("t")}) AS n, {times("t || ' '", r"[.!?]\s")} AS ends, {times("t", r"\b\d{3,4}\b")} AS numbers FROM (SELECT id, {strip("coalesce(quote, '')")} AS t FROM {{drafts}}) AS q) AS x""",
    "str28_domains": """
        SELECT id, CASE WHEN contains(c, 'mechanism') OR regexp_matches(n, 'mechanism|pathway|regulation|physiology') THEN 'mechanism_causal' WHEN regexp_matches(n, 'pressure|volume| flow|resistance|compliance|cardiac output|gradient|starling') THEN 'pressure_volume_quantitative'
          WHEN regexp_matches(c, 'complication|classic association') OR regexp_matches(n, ' versus | vs |differential|distinction|comparison') THEN 'comparison_differential' WHEN regexp_matches(c, 'clinical presentation|treatment|diagnostic method|drug|pharmacology') OR regexp_matches(n, 'management|presentation|diagnosis|therapy|treatment') THEN 'clinical_application'
          ELSE 'entity_recall' END AS domain FROM (SELECT id, lower(name) AS n, lower(category) AS c FROM {domain_concepts}) AS x""",
    "str29_anchor_support": rf"""
        SELECT id, coalesce(len(p) > 0 AND len(q) > 0 AND (len(list_intersect(p, q)) >= 2 OR len(list_intersect(p, q)) / len(p) >= 0.5), false) AS supported FROM (SELECT id,
          list_distinct(list_filter(string_split({evidence_text("clue")}, ' '), lambda w: length(w) >= 3 AND NOT list_contains({listed(EVIDENCE_STOP)}, w))) AS p, list_distinct(list_filter(string_split({evidence_text("s0")}, ' '), lambda w: length(w) >= 3 AND NOT list_contains({listed(EVIDENCE_STOP)}, w))) AS q FROM {{drafts}}) AS x""",
    "str32_overlap": f"SELECT id, floor(len(list_intersect(p, q)) / greatest(len(p), len(q)) * 1000000 + 0.5) / 1000000 AS overlap FROM (SELECT id, list_distinct(string_split({label('a')}, ' ')) AS p, list_distinct(string_split({label('b')}, ' ')) AS q FROM {{option_texts}}) AS x",
    "str33_similar_options": rf"""
        WITH o AS (SELECT id, {option_text("options[1]")} AS x, {option_text("options[2]")} AS y, {option_text("concat('a) ', a, ' disease')")} AS u, {option_text("concat(b, ' ', a)")} AS v FROM {{drafts}}),
        t AS (SELECT *, list_filter(string_split(x, ' '), lambda w: length(w) >= 3 AND NOT list_contains({listed(NOISE)}, w)) AS p, list_filter(string_split(y, ' '), lambda w: length(w) >= 3 AND NOT list_contains({listed(NOISE)}, w)) AS q,
          list_filter(string_split(u, ' '), lambda w: length(w) >= 3 AND NOT list_contains({listed(NOISE)}, w)) AS r, list_filter(string_split(v, ' '), lambda w: length(w) >= 3 AND NOT list_contains({listed(NOISE)}, w)) AS s FROM o)
        SELECT id, CASE WHEN x = '' OR y = '' THEN false WHEN contains(x, y) OR contains(y, x) THEN true WHEN len(p) = 0 OR len(q) = 0 THEN false ELSE len(list_filter(p, lambda w: list_contains(q, w))) / least(len(p), len(q)) > 0.65 END AS first_two,
          CASE WHEN u = '' OR v = '' THEN false WHEN contains(u, v) OR contains(v, u) THEN true WHEN len(r) = 0 OR len(s) = 0 THEN false ELSE len(list_filter(r, lambda w: list_contains(s, w))) / least(len(r), len(s)) > 0.65 END AS made FROM t""",
    "str40_clinical_support": rf"""
        SELECT id, (CASE WHEN regexp_matches(x, '(?i)\b(patient|presents?|year.old|male|female|complain|symptom|sign|vital|lab|imaging|exam|diagnosis|management|treatment|history|physical|workup|finding|fever|pain|dyspnea|fatigue|nausea|vomiting|diarrhea|rash|edema|tachycardia|bradycardia|hypertension|hypotension|biopsy|CBC|BMP|CXR|CT|MRI|EKG|ECG)\b') THEN 2 ELSE 0 END)
          >= greatest(2, len(regexp_split_to_array(x, '\s+')) / 200) AS supported FROM (SELECT id, concat_ws(' ', text, CASE WHEN id % 3 = 0 THEN 'a patient with fever and pain' END) AS x FROM {{bank_pages}}) AS y""",
    "str41_feature_texts": """
        SELECT id, CASE kind WHEN 1 THEN 'same mechanistic comparison class' WHEN 2 THEN 'same therapeutic/pharmacologic comparison class' WHEN 3 THEN 'same clinical differential neighborhood' ELSE concat(lower(category), ' comparison class shared with ', name) END AS shared,
          CASE WHEN id % 5 = 0 THEN 'given' WHEN kind = 1 THEN concat('the deciding clue separates X from ', name, ' at the mechanism level') WHEN kind = 2 THEN concat('the stem must distinguish X from ', name, ' by indication, adverse effect, or mechanism') ELSE concat('the stem must distinguish X from ', name, ' using one clinically meaningful feature') END AS differs
        FROM (SELECT *, CASE WHEN regexp_matches(category, '(?i)mechanism|pathway|physiology') OR regexp_matches(domain, '(?i)mechanism|causal') THEN 1 WHEN regexp_matches(category, '(?i)drug|pharmacology') THEN 2 WHEN regexp_matches(category, '(?i)condition|presentation|complication|association') THEN 3 ELSE 4 END AS kind FROM {domain_concepts}) AS x""",
    "mth17_definition_scores": rf"""
        WITH o AS (SELECT id, options[1] AS x, options[2] AS y, concat(a, '/', b, ' (x) one two three') AS u, s0 AS v FROM {{drafts}}),
        n AS (SELECT *, len(list_filter(string_split({option_text("x")}, ' '), lambda w: length(w) >= 3)) AS nx, len(list_filter(string_split({option_text("y")}, ' '), lambda w: length(w) >= 3)) AS ny, len(list_filter(string_split({option_text("u")}, ' '), lambda w: length(w) >= 3)) AS nu, len(list_filter(string_split({option_text("v")}, ' '), lambda w: length(w) >= 3)) AS nv FROM o)
        SELECT id, CAST(10 - least(abs(nx - ny), 6) - CASE WHEN regexp_matches(x, '\([^)]+\)') <> regexp_matches(y, '\([^)]+\)') THEN 3 ELSE 0 END - CASE WHEN contains(x, '/') <> contains(y, '/') THEN 2 ELSE 0 END AS BIGINT) AS score,
          CAST(10 - least(abs(nu - nv), 6) - CASE WHEN regexp_matches(u, '\([^)]+\)') <> regexp_matches(v, '\([^)]+\)') THEN 3 ELSE 0 END - CASE WHEN contains(u, '/') <> contains(v, '/') THEN 2 ELSE 0 END AS BIGINT) AS made FROM n""",
    "win06_copied_stems": rf"""
        WITH d AS (SELECT id, {copied("stem")} AS s, {copied("source")} AS t, regexp_matches(stem, '\?|(?i)\bwhich of the following\b|(?i)\bwhat is (?:the )?most likely\b|(?i)\bmost likely to be (?:recorded|observed|seen|found|present)\b|(?i)\b[a-z]-year-old\s+(?:man|woman|male|female|boy|girl)\b') AS asks FROM {{drafts}}),
        r AS (SELECT *, string_split(s, ' ') AS ws, least(28, greatest(18, CAST(floor(len(string_split(s, ' ')) * 0.45) AS INT))) AS run FROM d)
        SELECT id, asks AND length(s) >= 80 AND (contains(t, s) OR (len(ws) >= run AND len(list_filter(generate_series(1, greatest(1, len(ws) - run + 1)), lambda i: contains(t, array_to_string(ws[i : i + run - 1], ' ')))) > 0)) AS copied FROM r""",
    "alg13_draft_faults": rf"""
        WITH d AS (SELECT id, level, stem, options, answer, CASE WHEN id % 7 = 0 THEN level % 3 + 1 ELSE level END AS want, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'c2' ELSE 'c1' END AS concept, CASE id % 4 WHEN 0 THEN 'Heart (failure)' WHEN 1 THEN 'heart  failure' ELSE 'Stroke' END AS name FROM {{drafts}}),
        e AS (SELECT *, CASE WHEN want = 1 THEN 5 ELSE 4 END AS n FROM d),
        f AS (SELECT *, [CASE WHEN stem = '' OR len(options) = 0 OR answer < 0 THEN 'Draft is missing the stem, options, or correctAnswer fields.' END, CASE WHEN len(options) <> n THEN concat('Level ', want, ' questions must have exactly ', n, ' answer choices.') END, CASE WHEN answer >= len(options) THEN 'correctAnswer must point to an existing option.' END,
          CASE WHEN concept = '' THEN 'Draft is missing conceptId for the requested generation slot.' WHEN concept <> 'c1' THEN 'Draft conceptId does not match the requested generation slot.' END] AS hard,
          [CASE WHEN {plain("name")} <> 'heart failure' THEN 'Draft conceptName does not match the requested generation slot.' END, CASE WHEN level <> want THEN concat('Draft level ', level, ' does not match expected level ', want, '.') END] AS soft FROM e)
        SELECT id, array_to_string(list_filter(list_concat(hard, soft), lambda i: i IS NOT NULL), ' ~ ') AS issues, len(list_filter(hard, lambda i: i IS NOT NULL)) > 0 AS retry, len(list_filter(hard, lambda i: i IS NOT NULL)) = 0 AS checked FROM f""",
    "fil16_request_faults": """
        SELECT id, CASE WHEN question = '' THEN 'questionId is required' WHEN option IS NULL OR option < -1 OR option <> floor(option) THEN 'selectedOption must be an integer >= -1' WHEN correct IS NULL THEN 'isCorrect must be a boolean' WHEN ms < 0 OR ms <> floor(ms) THEN 'timeSpentMs must be a non-negative integer'
          WHEN reason = 'none' THEN 'Invalid flagReason' END AS fault FROM {attempt_requests}""",
    "fil17_slugs": r"""
        SELECT id, CASE WHEN length(trim(slug)) BETWEEN 1 AND 96 AND regexp_matches(trim(slug), '^[A-Za-z0-9][A-Za-z0-9-]*$') THEN trim(slug) END AS slug, CASE WHEN path IN ('/app', '/app#top') OR (path LIKE '/s/%' AND regexp_matches(path, '^/s/[A-Za-z0-9][A-Za-z0-9-]*\?')) THEN path ELSE '/app' END AS path FROM {paths}""",
    "fil18_template_stems": "SELECT id, starts_with(lower(stem), 'in the source passage, which named concept is described by \"') AS template FROM {drafts}",
    "str38_clues": r"""SELECT id, coalesce(nullif(regexp_extract(stem, '(?i)described by ["''](.+?)["''][\s?]*$', 1), ''), stem) AS clue FROM {drafts}""",
    "str26_canonical_issues": f"""
        SELECT id, CASE id % 7 WHEN 0 THEN 'missing_key_distinction' WHEN 1 THEN 'missing_distractor_contrast' WHEN 2 THEN 'source_quote_not_verified' WHEN 3 THEN 'correct_answer_not_supported' WHEN 4 THEN 'explanation_answer_mismatch' WHEN 5 THEN 'fabricated_distractor' ELSE {plain("concat('Something else, entirely ', a)")} END AS form FROM {{drafts}}""",
    "mth12_length_tells": rf"""
        WITH d AS (SELECT id, options, answer, list_transform(options, lambda o: len({words("o")})) AS n FROM {{drafts}}),
        m AS (SELECT *, coalesce(n[answer + 1], 0) > 1.4 * list_median(n) AND list_median(n) > 0 AS tells, {strip("options[answer + 1]")} AS t, list_median(list_filter(n, lambda v, i: i <> answer + 1)) AS middle FROM d),
        p AS (SELECT *, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM m),
        s AS (SELECT *, CASE WHEN len(parts) > 1 THEN trim(array_to_string(parts[:-2], ' ')) ELSE trim(regexp_replace(regexp_replace(t, '(?is)(?:\s*[,;:]\s*|\s+-\s+|\s+)(?:because|which|allowing|while|since|as|so that)\b.*$', ''), '[\s,;:.-]+$', '')) END AS short FROM p)
        SELECT id, tells, CASE WHEN tells AND short <> '' AND short <> t AND middle > 0 AND len({words("short")}) <= middle * 1.4 THEN short END AS repaired FROM s""",
    "alg16_concept_mismatches": f"""
        WITH d AS (SELECT id, concat(' ', {plain("stem")}, ' ') AS s, concat(' ', {plain("coalesce(options[answer + 1], '')")}, ' ') AS k, a, b FROM {{drafts}}),
        n AS (SELECT id, s, k, list_filter(list_concat([concat(a, ' ', b), 'one renin', 'renin'], CASE WHEN length(b) >= 4 THEN [b] ELSE [] END), lambda x: length(x) >= 2) AS names FROM d),
        z AS (SELECT id, s, k, list_concat(names, list_transform(names, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y' WHEN ends_with(w, 'ses') AND length(w) > 4 THEN w[:-3] WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN w[:-2] ELSE w END), ' '))) AS names FROM n)
        SELECT id, len(list_filter(names, lambda x: contains(s, concat(' ', x, ' ')) OR contains(k, concat(' ', x, ' ')))) = 0 AS mismatch FROM z""",
    "joi13_candidate_pairs": f"""
        WITH p AS (SELECT id, list_slice({stem_tokens('text')}, 1, 12) AS t FROM {{chunks}}),
        c AS (SELECT t, min(id) AS rep FROM p WHERE t IS NOT NULL GROUP BY t),
        pairs AS (SELECT a.rep AS i, b.rep AS j, len(list_filter(a.t, lambda w: list_contains(b.t, w))) AS shared FROM c a JOIN c b ON a.rep <> b.rep)
        SELECT c.rep AS i, p.id AS j, 1 AS same_fingerprint, CAST(len(p.t) AS BIGINT) AS shared FROM p JOIN c ON c.t = p.t WHERE p.id <> c.rep
        UNION ALL SELECT i, j, 0, CAST(shared AS BIGINT) FROM pairs WHERE shared >= 6""",
}
SQL |= {
    "mth15_keyword_score": f"""
        WITH t AS (SELECT query_id, unnest(list_distinct(list_filter(string_split({plain("text")}, ' '), lambda w: length(w) >= 4))) AS term FROM {{queries}}), c AS (SELECT id, {plain("coalesce(text, '')")} AS x FROM {{chunks}})
        SELECT query_id, id, floor(sum(greatest(1, length(term) / 8.0)) * 1000000 + 0.5) / 1000000 AS score FROM t JOIN c ON contains(x, term) GROUP BY query_id, id""",
    "win03_headers": rf"""
        WITH l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda t: length(t) >= 4 AND len({words("t")}) BETWEEN 1 AND 8) AS ls FROM {{bank_pages}})
        SELECT id, array_to_string(list_slice(list_filter(ls, lambda t: (t = upper(t) AND regexp_matches(t, '[A-Z]')) OR (regexp_matches(t, '^[A-Z]') AND len(list_filter(string_split(t, ' '), lambda w: length(w) > 3 AND NOT regexp_matches(w, '^[A-Z]'))) = 0)), 1, 3), ' ~ ') AS headers FROM l""",
    "qrk07_empty_fingerprints": f"SELECT id, min(id) OVER () AS class FROM {{chunks}} WHERE len({stem_tokens("coalesce(text, '')")}) = 0",
    "jsn04_coerced_questions": """
        SELECT event_id AS id, concat(event_type, ' a ~ ', event_id, ' ~ true ~ b') AS options, CAST(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS answer, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS level FROM events""",
    "stm05_coupled_reviews": """
        SELECT user_id, question_id, count(*) AS reviews, CAST(sum(own) AS BIGINT) AS counted FROM (SELECT user_id, question_id, 1 AS own FROM {answers} UNION ALL SELECT user_id, proxied_from_id, 0 FROM {answers} WHERE proxied_from_id IS NOT NULL AND quality >= 3) AS x GROUP BY user_id, question_id""",
}
SQL["mth09_cost_estimates"] = """
    WITH k AS (SELECT * FROM (VALUES ('standard', false, 2000, 1700, 47, 2.05), ('standard', true, 2000, 1700, 243, 2.05), ('comprehensive', false, 1800, 1476, 28, 2.75), ('comprehensive', true, 1800, 1476, 181, 2.75), ('boards', false, 1500, 1200, 20, 3.0), ('boards', true, 1500, 1200, 166, 3.0)) AS v(density, rewritten, words, step, cap, levels)),
    a AS (SELECT pages, density, rewritten, words, CAST(levels AS DOUBLE) AS levels, CASE WHEN pages * 550 <= words THEN 1 ELSE 1 + CAST(ceil((pages * 550 - words) / step) AS BIGINT) END AS chunks, greatest(12, CAST(floor(pages / 100 * 140 + 0.5) AS BIGINT)) AS concepts, cap FROM (SELECT DISTINCT page_count * 12 AS pages FROM {pdfs}) p CROSS JOIN k),
    b AS (SELECT *, least(concepts, cap) AS included, CAST(floor(least(concepts, cap) * levels + 0.5) AS BIGINT) AS questions, CAST(ceil(chunks / 3) AS BIGINT) AS batches FROM a),
    c AS (SELECT *, floor(questions * 1.08::DOUBLE + 0.5) AS slots, ceil(included / 3) AS groups, floor(questions * CASE WHEN rewritten THEN 0.18::DOUBLE ELSE 0.35::DOUBLE END + 0.5) AS revised FROM b),
    d AS (SELECT *, floor((chunks * 431 + included * 58 + included * 25) / 1000000.0::DOUBLE * 0.02::DOUBLE * 1000000.0::DOUBLE + 0.5) AS embeddings, floor((batches * (650 + floor(words * 3 * 1.38::DOUBLE + 0.5)) / 1000000.0::DOUBLE * 0.15::DOUBLE + batches * 1350 / 1000000.0::DOUBLE * 0.6::DOUBLE) * 1000000.0::DOUBLE + 0.5) AS inventory, floor(((500 + included * CASE WHEN rewritten THEN 10 ELSE 8 END) / 1000000.0::DOUBLE * 0.15::DOUBLE + 800 / 1000000.0::DOUBLE * 0.6::DOUBLE) * 1000000.0::DOUBLE + 0.5) AS confusion,
      CASE WHEN rewritten THEN floor((slots * 3355 / 1000000.0::DOUBLE * 2.5::DOUBLE + slots * 250 / 1000000.0::DOUBLE * 10) * 1000000.0::DOUBLE + 0.5) ELSE floor(((groups * 5200 + included * 850) / 1000000.0::DOUBLE * 2.5::DOUBLE + questions * 240 / 1000000.0::DOUBLE * 10) * 1000000.0::DOUBLE + 0.5) END AS writer,
      CASE WHEN rewritten THEN floor(((greatest(1, ceil(questions / 8)) * 1500 + questions * 280) / 1000000.0::DOUBLE * 2.5::DOUBLE + questions * 60 / 1000000.0::DOUBLE * 10) * 1000000.0::DOUBLE + 0.5) ELSE floor(((groups * 1500 + questions * 300) / 1000000.0::DOUBLE * 2.5::DOUBLE + questions * 65 / 1000000.0::DOUBLE * 10) * 1000000.0::DOUBLE + 0.5) END AS auditor,
      CASE WHEN rewritten THEN floor((revised * 1850 / 1000000.0::DOUBLE * 2.5::DOUBLE + revised * 245 / 1000000.0::DOUBLE * 10) * 1000000.0::DOUBLE + 0.5) ELSE floor((revised * 1750 / 1000000.0::DOUBLE * 2.5::DOUBLE + revised * 250 / 1000000.0::DOUBLE * 10) * 1000000.0::DOUBLE + 0.5) END AS revisions FROM c)
    SELECT pages, density, rewritten, CAST(chunks AS BIGINT) AS chunks, CAST(concepts AS BIGINT) AS concepts, CAST(included AS BIGINT) AS included, questions, (embeddings + inventory + confusion + writer + auditor + revisions) / 1000000 AS total FROM d"""
SQL["alg27_relevant_chunks"] = f"""
    SELECT query_id, id, CAST(k AS BIGINT) AS place FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0) DESC, c.id) AS k FROM {{queries}} q CROSS JOIN {{chunks}} c LEFT JOIN ({SQL["mth15_keyword_score"]}) s ON s.query_id = q.query_id AND s.id = c.id) AS x WHERE k <= 4"""
SQL["stm02_until_terminal"] = f"""
    WITH e AS ({SQL["src09_event_blocks"]}), f AS (SELECT *, min(place) FILTER (phase = 7 OR lower(trim(message)) = 'done') OVER (PARTITION BY job_id) AS stop FROM e)
    SELECT job_id, count(*) AS events, max_by(phase, place) AS phase, max_by(message, place) AS message FROM f WHERE stop IS NULL OR place <= stop GROUP BY job_id"""
