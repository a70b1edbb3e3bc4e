"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from parley.llm.chat import CONTROL, END, START

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _pattern(strings: list[str]) -> str:
    escaped = ["".join(f"\\{c}" if c in "|[]<>/" else c for c in s) for s in sorted(strings, key=len, reverse=True)]
    return "|".join(escaped)


ORACLES: dict[str, str] = {
    "op4_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        items AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        places AS (SELECT item, w, n, unnest(range(len(w) - n + 1)) AS a FROM items),
        phrases AS (SELECT DISTINCT item, n, array_to_string(w[a + 1 : a + n], ' ') AS phrase FROM places),
        windows AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS a FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
        found AS (SELECT doc_id, a, x.n AS n, item FROM
                  (SELECT doc_id, a, n, array_to_string(w[a + 1 : a + n], ' ') AS phrase FROM windows) AS x JOIN phrases USING (n, phrase)),
        words AS (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS word FROM (SELECT DISTINCT doc_id, a, n FROM found)),
        hits AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
        names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op5_chat_formatting": rf"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (SELECT *, {len(START) + len(END) + 2} + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
                         + len(regexp_extract_all(text, '{_pattern(CONTROL)}')) AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op11_lexical_search": rf"""
        WITH words AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
        counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
        margins AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // length) AS m FROM lengths, corpus),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
                    FROM counts, corpus GROUP BY term, docs),
        pairs AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
        scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
                   FROM pairs JOIN weights USING (term) JOIN counts USING (term) JOIN margins USING (doc_id) GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score
                   FROM scores WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT id, label, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
        anchors AS (SELECT * FROM parts WHERE id % 100 = 0),
        scores AS (SELECT a.id AS anchor, a.label AS own, b.id AS id, b.label AS label, CAST(sum(a.x * b.x) AS BIGINT) AS score
                   FROM anchors AS a JOIN parts AS b USING (i) WHERE a.id <> b.id GROUP BY ALL),
        positives AS (SELECT anchor, id, score FROM scores WHERE own = label
                      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
        ranked AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                          row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS place
                   FROM positives AS p JOIN scores AS n ON n.anchor = p.anchor AND n.own <> n.label
                   AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
        SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE place <= 5""",
}
