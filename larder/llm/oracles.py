"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from larder.llm.licenses import LEAST_SHARE, LOWER, UPPER, WORD, templates


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {base}, {place}, '{word}', {must})" for t, label, base, place, word, must in templates())


LICENSES = f"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
    FROM documents),
template(template, label, base, place, word, mandatory) AS (VALUES {_values()}),
stands AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts),
held AS (SELECT word, count(DISTINCT row) AS held FROM stands WHERE word IN (SELECT word FROM template) GROUP BY word),
weighed AS (
    SELECT t.*, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(held, 0) + 1)) + 1 AS idf
    FROM template t LEFT JOIN held USING (word)),
whole AS (SELECT template, sum(idf) AS whole, count(*) FILTER (mandatory) AS must FROM weighed GROUP BY template),
aligned AS (
    SELECT row, template, label, base, pos - place AS start, sum(idf) AS weight, count(*) FILTER (mandatory) AS n
    FROM stands JOIN weighed USING (word) GROUP BY ALL),
good AS (
    SELECT *, least(1.0, weight / whole) AS share FROM aligned JOIN whole USING (template)
    WHERE n = must AND weight / whole >= {LEAST_SHARE}),
found AS (
    SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM good GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM texts LEFT JOIN found USING (row)"""

EMBEDDINGS = """
WITH RECURSIVE good AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
    SELECT a.vec_id, b.vec_id AS other FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached(vec_id, other) AS (
    SELECT vec_id, vec_id FROM good UNION SELECT r.vec_id, l.other FROM reached r JOIN link l ON r.other = l.vec_id),
component AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
links AS (SELECT vec_id, count(*) AS n FROM link GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
    coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component USING (vec_id) LEFT JOIN links USING (vec_id)"""

WHOLE = """
    SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

HARD_NEGATIVES = f"""
WITH good AS (
    SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({WHOLE}) WHERE label IS NOT NULL),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
    other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

TOP_PRODUCTS = f"""
WITH good AS ({WHOLE})
SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS INTEGER) AS rank,
    b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
QUALIFY rank <= 5"""

ORACLES = {
    "op1_license_scan": LICENSES,
    "op9_cover_tree_dedup": EMBEDDINGS,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op13_bit_sliced_search": TOP_PRODUCTS,
}
