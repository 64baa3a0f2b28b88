"""The dealt operators as DuckDB SQL, where SQL can express them."""

from .licenses import APART, CONTAINMENT, PHRASES, SPAN, TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

op5_decontamination = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, r.n, item_id FROM runs r JOIN windows USING (n, words)),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


def _license_scan() -> str:
    """Every run of every text against every template, and every place against every phrase."""
    rows = [(label, text, *APART.get(label, ([], []))) for label, texts in sorted(TEMPLATES.items()) for text in texts]
    templates = ", ".join(
        f"({i}, '{label}', '{text}', [{', '.join(map(_listed, needed))}]::VARCHAR[][], {_listed(never)})"
        for i, (label, text, needed, never) in enumerate(rows)
    )
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES.items())
    return rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {phrases}) AS v(phrase, label)),
templates AS (
    SELECT id, label, list_distinct(regexp_extract_all(text, '{WORD}')) AS t,
        floor(len(regexp_extract_all(text, '{WORD}')) * {SPAN})::BIGINT AS span, needed, never
    FROM (VALUES {templates}) AS v(id, label, text, needed, never)
),
held AS (SELECT doc_id, w, label, t, span, needed, never FROM dw, templates WHERE len(list_intersect(w, t)) >= {CONTAINMENT} * len(t) - 1e-9),
runs AS (
    SELECT doc_id, label, t, needed, never, w[k:k + span - 1] AS run
    FROM (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i]))) AS k FROM held)
),
met AS (
    SELECT doc_id, label, len(list_intersect(run, t)) / len(t) AS share FROM runs
    WHERE len(list_intersect(run, t)) >= {CONTAINMENT} * len(t) - 1e-9 AND NOT list_has_any(run, never)
        AND len(list_filter(needed, lambda ways: list_has_any(run, ways))) = len(needed)
),
base AS (
    SELECT doc_id, i - 1 AS place, label
    FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) + 1)) AS i FROM dw, phrases) WHERE w[i:i + len(p) - 1] = p
),
per_base AS (
    SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM base GROUP BY doc_id
),
per_doc AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc_id, label FROM met UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id
),
shares AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM dw LEFT JOIN per_base USING (doc_id) LEFT JOIN per_doc USING (doc_id) LEFT JOIN shares USING (doc_id)
"""


op11_hard_negatives = """
WITH usable AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i]))::BIGINT AS score
    FROM usable a JOIN usable r ON len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT anchor_id, positive_id,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

op13_filter_audit = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM docs),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
        concat(
            CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
            CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' END,
            CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN low < doc_id THEN 'E' END) AS fails
    FROM worded LEFT JOIN marks USING (doc_id)
),
counts AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (
    SELECT filter_order, step, filter_order[step] AS own, string_split(left(filter_order, step - 1), '') AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
found AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS here,
        len(list_filter(earlier, lambda l: l <> '' AND contains(fails, l))) > 0 AS gone
    FROM counts, steps
),
summed AS (
    SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM found GROUP BY ALL
)
SELECT * EXCLUDE (own) REPLACE (step::INTEGER AS step), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed
"""


def oracles():
    return {
        "op11_hard_negatives": op11_hard_negatives,
        "op13_filter_audit": op13_filter_audit,
        "op6_license_scan": _license_scan(),
        "op5_decontamination": op5_decontamination,
    }
