"""Question drafts and question-bank pages, derived from the documents in shared SQL so that every branch of a rule fires."""

from __future__ import annotations

from .fixtures import FIXTURES


def pick(key: str, *cases: str) -> str:
    """A CASE over the remainders of key."""
    return f"CASE id % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + f" END AS {key}"


def lines(*texts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"'{t}'" for t in texts) + ", body)"


DRAFTS = FIXTURES | {
    "draft_words": r"""
        SELECT doc_id AS id, coalesce(text, '') AS source, WORDS(SWAP(coalesce(text, ''), '[^A-Za-z]+', ' ')) AS ws, WORDS(SWAP(coalesce(text, ''), '[ \t\n\r]+', ' ')) AS raw,
          ALLOF(SWAP(coalesce(text, ''), '[ \t\n\r]+', ' '), '[A-Z][^.!?]*[.!?]') AS ss
        FROM {documents}""",
    "draft_parts": """
        SELECT id, source, raw, coalesce(lower(ITEM(ws, 0)), 'alpha') AS a, coalesce(lower(ITEM(ws, 3)), 'beta') AS b, coalesce(lower(ITEM(ws, 5)), 'gamma') AS c, coalesce(lower(ITEM(ws, 7)), 'delta') AS d,
          coalesce(ITEM(ss, 0), 'No sentence of this kind is here.') AS s0, coalesce(ITEM(ss, 1), 'Nor a second one.') AS s1 FROM {draft_words}""",
    "draft_options": "SELECT id, source, raw, a, b, c, d, s0, s1, CAST(id % 3 AS INT) + 1 AS level, CAST(CASE id % 17 WHEN 10 THEN 7 ELSE id % 4 END AS INT) AS answer, PARTS(options) AS options FROM (SELECT *, "
    + pick(
        "options",
        "concat(a, ' level|', b, ' level|', c, ' level|', d, ' level')",
        "concat('All of the above|', a, '|', b, '|', c, '|', d)",
        "concat('administer ', a, '|stop ', b, '|', c, ' syndrome|', d, ' disease')",
        "concat(a, ' (', b, ')|', c, '|', d, '|omega')",
        "concat(a, '|', b, '|', c, '|', s0)",
        "concat(a, ' ', b, ' upper gamma|', a, ' ', b, ' upper delta|', c, '|', d)",
        "concat('renal artery ', a, '|loop of ', b, '|glomerular filtration|tubular reabsorption ', c)",
        "concat(a, ' ', b, ' mechanism|', b, ' ', c, ' process|', c, ' ', d, ' structure|', d, ' ', a, ' control|omega')",
        "concat('A. ', a, 'ies|b) ', b, 's|C. ', c, '|D) ', d)",
        "'12 mg/dL|14 mg/dL|16 mg/dL|-18.5 mg/dL'",
        "concat(a, '|', b, '|', s0, ' because ', s1, '|', d)",
        "concat(a, ' ', b, ' ', c, ' and some more of it, because that rises and then falls again|', b, ' and some more of it here|', c, ' with a few more words|', d, ' as long as the others are')",
        "concat(a, ' and then some more words|', b, ' of which no more is said|', c, ' alone, since nothing else in the whole of the text above would do|', d, ' for want of any other')",
    )
    + " FROM {draft_parts}) AS o",
    "drafts": "SELECT id, source, level, answer, options, a, b, s0, "
    + ", ".join(
        [
            pick("stem", "concat('Which of the following is not caused by ', a, '?')", "concat('A 45-year-old male presents with ', a, ' and ', b, '. What is the most likely cause?')", "concat('Which anatomical structure is close to ', a, '?')", "concat('The ', a, ' is described in the text.')", "concat(TEXTOF(HEAD(raw, 40)), '?')", "concat('Consider ', a, '. Choose the best statement (see p. 12)')", "''", "concat('What raises ', a, ' (ref 3)?')", "concat(' a 7-year-old female presenting with ', b, '. Identify the lesion')", "concat('The condition defined by ', a, ' is which?')", "concat('How does ', b, ' differ from ', a, '? ')", "concat('All except ', a)", "concat('In the source passage, which named concept is described by \"', s0, '\"?')"),  # noqa: E501
            pick("explanation", "concat('It is ', coalesce(ITEM(options, answer), 'none'), ' because the text says so at great length and in several words, more than a dozen.')", "concat(coalesce(ITEM(options, (answer + 1) % 4), 'none'), ' is correct because of much that the text says about this matter here and there.')", "''", "CAST(NULL AS STRING)", "'Short one.'", "concat('Key distinction: ', s0, ' That is all there is to it, in so many words.')", "concat('Unlike ', coalesce(ITEM(options, 1), 'that'), ', this fails because the source holds no word of it. ', s1)"),  # noqa: E501
            pick("quote", "s0", "concat('- ', s0)", "'UNGROUNDED'", "CAST(NULL AS STRING)", "concat(s0, ' ', s1)", "SWAP(s0, ' ', '  ')", "'This sentence was invented for the test and stands in no source text at all, as one sees.'", "TEXTOF(HEAD(raw, 12))", "'Which of the following is the first and most often seen of all findings here?'", "TEXTOF(HEAD(raw, 50))"),  # noqa: E501
            pick("clue", "TEXTOF(HEAD(WORDS(s0), 3))", "CAST(NULL AS STRING)", "'three quite foreign words'", "a", "concat(a, ' ', b, ' ', a)"),
            pick("target", "'mechanism'", "''", "a"),
            pick("distractor", "coalesce(ITEM(options, (answer + 1) % 4), '')", "coalesce(ITEM(options, answer), '')", "CAST(NULL AS STRING)", "concat('B. ', coalesce(ITEM(options, (answer + 2) % 4), ''))"),
            pick("tempting", "'It looks alike.'", "CAST(NULL AS STRING)"),
            pick("fails", "'It is another.'", "'It is not.'", "''"),
        ]
    )
    + " FROM {draft_options}",
    "bank_bodies": "SELECT doc_id AS id, CAST(floor(doc_id / 40) AS BIGINT) AS book, coalesce(text, '') AS body FROM {documents}",
    "bank_pages": "SELECT id, book, id AS page, "
    + pick(
        "text",
        lines("Unit III Heart and Vessels", "12. Which value rises", "A) One", "B) Two", "C) Three", "D) Four", "13. What falls", "A) Up", "B) Down", "C) Left", "D) Right"),
        lines("ANSWERS", "12. B) Because TMP13 p. 12", "13. C) Since PBD9 44"),
        lines("CHAPTER 4", "Blood Vessels", "1. Alpha rises", "2. Beta falls", "3. Gamma stays"),
        lines("1. A) Alpha TMP13 p. 1", "2. B) Beta BP9 22", "3. C) Gamma PBD8 7", "4. D) Delta BP8 9", "5 E Epsilon TMP13 4"),
        "body",
        lines("7 A Alpha", "8 B Beta", "9 C Gamma", "10 D Delta", "611 E Epsilon", "12 F Zeta"),
        lines("C H A P T E R 1 1 Cardiac Output of", "small hearts"),
        lines("INTRODUCTION AND SCOPE", "3 apples and", "IV.", "4. Of pears", "5-fold", "CHAPTER CONTENTS", "101 Alpha and its kin 102 Beta and its kin 103 Gamma and others 104 Delta of rivers 105 Epsilon of old 106 Zeta at last"),
    )
    + " FROM {bank_bodies}",
}
