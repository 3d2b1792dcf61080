"""SQL for the queries that SQL can express.

Not here: packing, token files, alignment and byte pairs (tokenizers), the language model and the
classifier (trained), and personal data (the added kinds need look-behind); these are tested
against plain versions.
"""

from __future__ import annotations

import math

from termloom.llm.licenses import PHRASES, SMALL, TEMPLATES, UPPER, block_length
from termloom.llm.rules import RuleOptions

_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{SMALL}')"


_OP5 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{_LETTERS}') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 13) AS n
  FROM (SELECT item_id, regexp_extract_all({_lower('text')}, '{_LETTERS}') AS w FROM benchmark)
  WHERE len(w) > 0),
sought AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS phrase
  FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM items)),
found AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
        FROM words, (SELECT DISTINCT n FROM sought) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, found.n, item FROM found JOIN sought USING (phrase)),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""

_OP8 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{_SPACED}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
edges AS (
  SELECT x, y FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (
  SELECT x, y FROM edges
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON x = doc_id"""


def _op6(threshold: float = 0.9) -> str:
    spots = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM places "
        f"WHERE array_to_string(w[i + 1:i + {len(p.split())}], ' ') = '{p}'"
        for p, label in PHRASES
    )
    templates = ", ".join(
        "('{}', [{}], {}, {}, {})".format(
            label,
            ", ".join(f"'{w}'" for w in sorted(set(t.split()))),
            len(set(t.split())),
            math.ceil(threshold * len(set(t.split()))),
            block_length(t),
        )
        for label, t in TEMPLATES
    )
    hints = " OR ".join(f"array_to_string(w, ' ') LIKE '%{p}%'" for p, _ in PHRASES)
    return rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{_LETTERS}') AS w FROM documents),
places AS MATERIALIZED (
  SELECT doc_id, w, unnest(range(len(w))) AS i FROM words WHERE {hints}),
spots AS ({spots}),
templates(label, t, size, need, length) AS (VALUES {templates}),
template_words AS (
  SELECT row_number() OVER () AS template, label, size, need, length, t FROM templates),
sought AS (SELECT template, unnest(t) AS word FROM template_words),
spread AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
hits AS MATERIALIZED (SELECT doc_id, template, word, i FROM spread JOIN sought USING (word)),
holding AS (
  SELECT doc_id, template FROM hits JOIN template_words USING (template)
  GROUP BY doc_id, template, need HAVING count(DISTINCT word) >= need),
met AS (
  SELECT a.doc_id, label, count(DISTINCT b.word) / CAST(size AS DOUBLE) AS share
  FROM holding h JOIN template_words t USING (template)
       JOIN hits a ON a.doc_id IS NOT DISTINCT FROM h.doc_id AND a.template = h.template
       JOIN hits b ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.template = a.template
                  AND b.i >= a.i AND b.i < a.i + length
  GROUP BY a.doc_id, a.template, a.i, label, size, need
  HAVING count(DISTINCT b.word) >= need),
based AS (
  SELECT doc_id, count(*) AS n_base, CAST(min(i) AS BIGINT) AS first_word,
         CAST(max(i) AS BIGINT) AS last_word,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels
  FROM spots GROUP BY doc_id),
named AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM (SELECT doc_id, label FROM spots UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
shares AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM words LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id)
     LEFT JOIN shares USING (doc_id)"""


def _op9(options: RuleOptions = RuleOptions()) -> str:
    ratios = {
        "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "upper_ratio": "n_upper / greatest(word_chars, 1)",
    }
    steps = ", ".join(
        "({}, {})".format(k, ", ".join("NULL::DOUBLE" if cut[r] is None else f"{cut[r]}::DOUBLE" for r in ratios))
        for k, cut in enumerate(options.ladder(), 1)
    )
    broken = " OR ".join(f"coalesce({r} >= cut_{r}, false)" for r in ratios)
    rate = options.false_rejections
    names = ", ".join(f"cut_{r}" for r in ratios)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
counted AS MATERIALIZED (
  SELECT doc_id, lang, regexp_extract_all(t, '{_SPACED}') AS w,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines
  FROM texts),
windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM counted WHERE len(w) > 4)),
twice AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM windows JOIN twice USING (doc_id, s))
  GROUP BY doc_id),
measured AS MATERIALIZED (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, n_upper, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM counted LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         {', '.join(f'CAST({v.split(" / ")[0]} AS DOUBLE) / {v.split(" / ")[1]} AS {k}' for k, v in ratios.items())}
  FROM measured),
good AS (
  SELECT judged.* FROM judged
  JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)
  WHERE NOT base_failed),
steps(step, {names}) AS (VALUES {steps}),
tried AS (
  SELECT lang, step, count(*) AS n, count(*) FILTER ({broken}) AS k
  FROM good, steps GROUP BY lang, step),
pooled AS (SELECT NULL AS lang, step, sum(n) AS n, sum(k) AS k FROM tried GROUP BY step),
tails AS (
  SELECT lang, step, lang IS NULL AS is_pooled,
         CASE WHEN k >= n * {rate} THEN 1.0 ELSE
           (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                           + j * ln({rate}) + (n - j) * ln(1 - {rate})))
            FROM (SELECT unnest(range(CAST(k AS BIGINT) + 1)) AS j)) END AS p
  FROM (SELECT * FROM tried UNION ALL SELECT * FROM pooled)),
reached AS (
  SELECT lang, is_pooled, count(*) FILTER (passed) AS step
  FROM (SELECT lang, is_pooled, step,
               bool_and(p <= CASE WHEN is_pooled THEN {options.delta / 2} ELSE
                 {options.delta / 2} / (SELECT count(DISTINCT lang) FROM good) END)
                 OVER (PARTITION BY is_pooled, lang ORDER BY step) AS passed FROM tails)
  GROUP BY lang, is_pooled),
chosen AS (
  SELECT lang, CASE WHEN coalesce(own.step, 0) > 0 THEN own.step
                    ELSE coalesce((SELECT step FROM reached WHERE is_pooled), 0) END AS step
  FROM (SELECT DISTINCT lang FROM judged) LEFT JOIN (SELECT * FROM reached WHERE NOT is_pooled) own
       USING (lang)),
verdicts AS (
  SELECT judged.*, coalesce({broken}, false) AS broken
  FROM judged JOIN chosen USING (lang) LEFT JOIN steps ON chosen.step = steps.step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT broken AS kept
FROM verdicts"""


_OP11 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a, vectors b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score
FROM negatives WHERE rank <= 5"""

ORACLE: dict[str, str] = {
    "op5_decontaminate": _OP5,
    "op6_licenses": _op6(),
    "op8_neardup": _OP8,
    "op9_rules": _op9(),
    "op11_hardneg": _OP11,
}
