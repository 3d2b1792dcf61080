"""The registered queries once more, as SQL for a second engine to check against.

The phrase logic is written with windows over a token table here, so it does not
share its shape with the array expressions it checks.
"""

from __future__ import annotations

import re

from termloom.functions import text as tx
from termloom.operators.calibrate import PASSES, RIDGE
from termloom.operators.linear import SMOOTH
from termloom.operators.split import fraction_bound
from termloom.plans.queries import (
    LANDMARKS, LINEAR_PASSES, MALFORMED, TOP_TERMS, TRAIN_FRACTION, TRAIN_ROWS,
)

_STOPWORDS = ", ".join(f"'{word}'" for word in tx.STOPWORDS)

_FEATURED = r"regexp_replace(coalesce({0}, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

_CORPUS = f"""
labelled AS (
  SELECT d.doc_id, d.source, d.text, l.quality
  FROM documents d LEFT JOIN labels l USING (doc_id)),
corpus AS (
  SELECT doc_id,
         CASE WHEN quality = 1 THEN 'p' WHEN quality = 0 THEN 'n' ELSE 'u' END || source
           AS cluster_id,
         quality AS label, {_FEATURED.format('text')} AS extracted_text
  FROM labelled)"""

_CONVERSATIONS = f"""
corpus AS (
  SELECT row_number() OVER () AS doc_id, CAST(conv_id AS VARCHAR) AS cluster_id,
         CAST(NULL AS INTEGER) AS label, {_FEATURED.format('text')} AS extracted_text
  FROM conversations)"""

_TOKENS = rf"""
sentences AS (
  SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS sent_id
  FROM (SELECT doc_id, string_split(
          regexp_replace(extracted_text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'),
          chr(1)) AS s FROM corpus)),
raw_tokens AS (
  SELECT doc_id, sent_id, unnest(t) AS token, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id, sent_id,
               regexp_extract_all(sentence, '{tx.TOKEN_PATTERN}') AS t FROM sentences)),
tokens AS (
  SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(pos AS INTEGER) AS pos, token,
         lower(token) AS lemma,
         CASE WHEN lower(token) IN ({_STOPWORDS}) THEN 'IN'
              WHEN regexp_matches(token, '{tx.LETTERS_PATTERN}') THEN 'NN'
              WHEN regexp_matches(token, '^\p{{N}}') THEN 'CD'
              ELSE 'SYM' END AS pos_tag
  FROM raw_tokens)"""

_WIDE = """
wide AS (
  SELECT * FROM tokens WHERE length(lemma) > 1 OR strlen(lemma) = 4)"""

_PHRASES = """
marked AS (
  SELECT *, sum(CASE WHEN pos_tag = 'NN' THEN 0 ELSE 1 END)
              OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS run,
            sum(CASE WHEN pos_tag = 'NN' THEN 0 ELSE 1 END)
              OVER (PARTITION BY doc_id, sent_id) AS last_run
  FROM wide),
all_phrases AS (
  SELECT doc_id, sent_id, run, run = last_run AS is_tail, list(lemma ORDER BY pos) AS words
  FROM marked WHERE pos_tag = 'NN' GROUP BY doc_id, sent_id, run, run = last_run),
phrases AS (SELECT * FROM all_phrases WHERE NOT is_tail)"""

_NGRAMS = """
ngrams AS (
  SELECT doc_id, array_to_string(words[1:g - 1], ' ') || ' ' || words[k] AS term
  FROM (SELECT doc_id, words, g, unnest(range(g, len(words) + 1)) AS k
        FROM (SELECT doc_id, words, unnest([2, 3, 4]) AS g FROM phrases)
        WHERE len(words) >= g))"""

_CONTIGUOUS = """
ngrams AS (
  SELECT doc_id, array_to_string(words[k:k + g - 1], ' ') AS term
  FROM (SELECT doc_id, words, g, unnest(range(1, len(words) - g + 2)) AS k
        FROM (SELECT doc_id, words, unnest([2, 3, 4]) AS g FROM all_phrases)
        WHERE len(words) >= g))"""

_TERMS = """
terms AS (
  SELECT doc_id, lemma AS term FROM wide UNION ALL SELECT doc_id, term FROM ngrams)"""

_DICTIONARY = """
counts AS (SELECT term, count(*) AS n FROM terms GROUP BY term),
dictionary AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n DESC, term) - 1 AS idx, term, n FROM counts)"""

_DOC_VECTORS = """
doc_vectors AS (
  SELECT doc_id, idx, CAST(count(*) AS DOUBLE) AS value
  FROM terms JOIN dictionary USING (term) GROUP BY doc_id, idx)"""


def _entries(aggregate: str) -> str:
    return f"""
clusters AS (
  SELECT cluster_id, min(label) AS label, count(*) AS n_docs
  FROM corpus GROUP BY cluster_id),
entries AS MATERIALIZED (
  SELECT cluster_id, idx, {aggregate} AS value
  FROM doc_vectors JOIN corpus USING (doc_id) JOIN clusters USING (cluster_id)
  GROUP BY cluster_id, idx)"""


_VECTOR_LINES = """
lines AS (
  SELECT cluster_id, CAST(label AS VARCHAR) AS label,
         string_agg(idx || ':' || CAST(value AS VARCHAR), ' ' ORDER BY idx) AS fields
  FROM clusters LEFT JOIN entries USING (cluster_id) GROUP BY cluster_id, label)"""

_EXPLAINED = """
doc_terms AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY doc_id, term),
merged AS MATERIALIZED (
  SELECT cluster_id, term, max(n) AS n FROM doc_terms JOIN corpus USING (doc_id)
  GROUP BY cluster_id, term)"""

_SCORES = """
truth AS (
  SELECT CAST(doc_id AS VARCHAR) AS cluster_id, quality AS class FROM labels),
text_scores AS (
  SELECT CAST(doc_id AS VARCHAR) AS cluster_id,
         CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score, lang FROM documents),
image_records AS (
  SELECT CAST(doc_id AS VARCHAR) AS cluster_id, doc_id * 2 AS line_no,
         CAST(toxic AS DOUBLE) / 2 AS score FROM labels
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), doc_id * 2 + 1,
         CAST(doc_id * 37 % 101 AS DOUBLE) / 100 FROM labels),
image_scores AS (
  SELECT cluster_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY line_no DESC) AS r
        FROM image_records) WHERE r = 1),
labelled_scores AS (
  SELECT cluster_id, class, score FROM truth JOIN text_scores USING (cluster_id)),
predicted AS (
  SELECT CAST(score >= 0.5 AS INTEGER) AS predicted, class AS actual FROM labelled_scores)"""

_ALL_PREDICTED = """
all_predicted AS (
  SELECT CAST(score >= 0.5 AS INTEGER) AS predicted, class AS actual
  FROM text_scores LEFT JOIN truth USING (cluster_id)),
cells AS (
  SELECT CASE WHEN predicted IN (0, 1) THEN CAST(predicted AS VARCHAR)
              WHEN predicted IS NULL THEN 'unlabelled' ELSE 'other' END AS predicted,
         CASE WHEN actual IN (0, 1) THEN CAST(actual AS VARCHAR)
              WHEN actual IS NULL THEN 'unlabelled' ELSE 'other' END AS actual
  FROM all_predicted)"""

_ROC = """
groups AS (
  SELECT score, count(*) FILTER (class = 1) AS pos, count(*) FILTER (class <> 1) AS neg
  FROM labelled_scores GROUP BY score),
running AS (
  SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp,
         sum(neg) OVER (ORDER BY score DESC) AS fp FROM groups),
totals AS (SELECT sum(pos) AS p, sum(neg) AS n FROM groups)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_TOKEN_PARTS = (_CORPUS, _TOKENS)
_PHRASE_PARTS = (*_TOKEN_PARTS, _WIDE, _PHRASES)
_TERM_PARTS = (*_PHRASE_PARTS, _NGRAMS, _TERMS)
_DICTIONARY_PARTS = (*_TERM_PARTS, _DICTIONARY)
_VECTOR_PARTS = (*_DICTIONARY_PARTS, _DOC_VECTORS)
_MAX_PARTS = (*_VECTOR_PARTS, _entries("max(value)"))
_CONVERSATION_PARTS = (
    _CONVERSATIONS, _TOKENS, _WIDE, _PHRASES, _NGRAMS, _TERMS, _DICTIONARY,
    _DOC_VECTORS, _entries("max(value)"),
)
_LABELLED_ONLY = _CORPUS.replace("FROM labelled)", "FROM labelled WHERE quality IS NOT NULL)")
_TURNS = """
corpus AS (
  SELECT row_number() OVER () AS doc_id,
         CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS cluster_id,
         CAST(NULL AS INTEGER) AS label, {0} AS extracted_text
  FROM conversations)""".format(_FEATURED.format("text"))


def _renamed(parts: tuple[str, ...], keep: str) -> str:
    """The same tables under other names, but for ``keep``."""
    text = ",".join(parts)
    names = set(re.findall(r"^(\w+) AS (?:MATERIALIZED )?\(", text, re.M)) - {keep}
    return re.sub(rf"\b({'|'.join(sorted(names))})\b(?!\()", r"other_\1", text)


_FOREIGN_PARTS = (
    _renamed((_LABELLED_ONLY, *_DICTIONARY_PARTS[1:]), "dictionary"),
    _TURNS, *_TERM_PARTS[1:], _DOC_VECTORS, _entries("max(value)"),
)
_LONG_VECTORS = """
SELECT cluster_id, label, n_docs, idx, {0} AS value
FROM clusters LEFT JOIN entries USING (cluster_id)"""

_ALIGNMENT = """
SELECT '{0}' AS submission, CAST(sum(a) AS BIGINT) AS n_truth,
       CAST(sum(b) AS BIGINT) AS n_submission,
       count(*) FILTER (b = 0) AS only_truth, count(*) FILTER (a = 0) AS only_submission,
       count(*) FILTER (a > 1) AS duplicate_truth,
       count(*) FILTER (b > 1) AS duplicate_submission
FROM (SELECT cluster_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b
      FROM (SELECT cluster_id, count(*) AS a FROM truth GROUP BY cluster_id)
      FULL JOIN (SELECT cluster_id, count(*) AS b FROM {1} GROUP BY cluster_id)
      USING (cluster_id))"""


def _platt_sql() -> str:
    """The passes of the fit one after another; each accepts its step or halves it."""
    parts = [
        """
targets AS MATERIALIZED (
  SELECT score * 2 - 1 AS m,
         CASE WHEN class = 1 THEN (p + 1) / (p + 2) ELSE 1 / (n + 2) END AS t
  FROM labelled_scores,
       (SELECT CAST(count(*) FILTER (class = 1) AS DOUBLE) AS p,
               CAST(count(*) FILTER (class <> 1) AS DOUBLE) AS n FROM labelled_scores)),
state0 AS MATERIALIZED (
  SELECT 0.0::DOUBLE AS a, ln((p + 1) / (n + 1)) AS b, CAST('infinity' AS DOUBLE) AS best,
         0.0::DOUBLE AS da, 0.0::DOUBLE AS db
  FROM (SELECT CAST(count(*) FILTER (class = 1) AS DOUBLE) AS p,
               CAST(count(*) FILTER (class <> 1) AS DOUBLE) AS n FROM labelled_scores))"""
    ]
    for k in range(PASSES):
        parts.append(f"""
sums{k} AS MATERIALIZED (
  SELECT sum(greatest(z, 0) + ln(1 + exp(-abs(z))) - t * z) AS loss,
         sum((p - t) * m) AS g1, sum(p - t) AS g0, sum(p * (1 - p) * m * m) + {RIDGE} AS h11,
         sum(p * (1 - p) * m) AS h10, sum(p * (1 - p)) + {RIDGE} AS h00
  FROM (SELECT *, CASE WHEN z >= 0 THEN 1 / (1 + exp(-abs(z)))
                       ELSE exp(-abs(z)) / (1 + exp(-abs(z))) END AS p
        FROM (SELECT m, t, m * (a + da) + b + db AS z FROM targets, state{k}))),
state{k + 1} AS MATERIALIZED (
  SELECT CASE WHEN loss < best THEN a + da ELSE a END AS a,
         CASE WHEN loss < best THEN b + db ELSE b END AS b, least(loss, best) AS best,
         CASE WHEN loss < best THEN -(h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10)
              ELSE da / 2 END AS da,
         CASE WHEN loss < best THEN -(h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10)
              ELSE db / 2 END AS db
  FROM state{k}, sums{k})""")
    return _with(_SCORES, *parts) + f"""
SELECT cluster_id, round(1 / (1 + exp(-(a * (score * 2 - 1) + b))), 6) AS p1
FROM text_scores, state{PASSES}"""


def _linear_sql() -> str:
    """The passes of the fit one after another, and the weights with the least loss."""
    parts = ["""
rows AS (
  SELECT vec_id, 2 * CAST(label < 5 AS INTEGER) - 1 AS y, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings),
plain AS (
  SELECT vec_id, y, CAST(unnest(range(len(x))) AS BIGINT) AS idx, unnest(x) AS value FROM rows),
e AS MATERIALIZED (SELECT * FROM plain UNION ALL SELECT vec_id, y, -1, 1.0 FROM rows),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM rows),
scale AS MATERIALIZED (
  SELECT idx, sum(value * value) / (""" + str(SMOOTH) + """ * max(n))
              + CASE WHEN idx = -1 THEN 0 ELSE 1 / max(n) END AS h
  FROM e, size GROUP BY idx),
w0 AS MATERIALIZED (SELECT idx, 0.0::DOUBLE AS w FROM scale)"""]
    for k in range(LINEAR_PASSES):
        step = (
            "SELECT 1.0::DOUBLE / (max(c) + 1) AS a, 1.0::DOUBLE / 3 AS growth "
            "FROM (SELECT count(*) AS c FROM e GROUP BY vec_id)"
            if k == 0
            else f"""
  SELECT next AS a, next / a AS growth
  FROM (SELECT a, CASE WHEN moved <= 0 OR 2 * a * a * turned / moved - 1 <= 0 THEN longest
                       ELSE least(longest, a / sqrt(2 * a * a * turned / moved - 1)) END AS next
        FROM (SELECT a, sqrt(2.0::DOUBLE / 3 + growth) * a AS longest, moved, turned
              FROM step{k - 1},
                   (SELECT sum(h * (n.w - o.w) ** 2) AS moved, sum((m.g - p.g) ** 2 / h) AS turned
                    FROM scale JOIN w{k} n USING (idx) JOIN w{k - 1} o USING (idx)
                         JOIN g{k} m USING (idx) JOIN g{k - 1} p USING (idx))))"""
        )
        parts.append(f"""
z{k} AS MATERIALIZED (
  SELECT vec_id, y, y * sum(value * w) AS z FROM e JOIN w{k} USING (idx) GROUP BY vec_id, y),
g{k} AS MATERIALIZED (
  SELECT idx, sum(value * y * CASE WHEN z >= 1 THEN 0 WHEN z > 1 - {SMOOTH} THEN (z - 1) / {SMOOTH}
                                   ELSE -1 END / n)
              + CASE WHEN idx = -1 THEN 0 ELSE any_value(w) / any_value(n) END AS g
  FROM e JOIN z{k} USING (vec_id, y) JOIN w{k} USING (idx), size GROUP BY idx),
loss{k} AS (
  SELECT {k} AS pass,
         (SELECT avg(CASE WHEN z >= 1 THEN 0
                          WHEN z > 1 - {SMOOTH} THEN (1 - z) * (1 - z) / (2 * {SMOOTH})
                          ELSE 1 - z - {SMOOTH} / 2 END) FROM z{k})
         + (SELECT sum(w * w) FROM w{k} WHERE idx >= 0) / (2 * n) AS loss FROM size),
step{k} AS MATERIALIZED ({step}),
w{k + 1} AS MATERIALIZED (
  SELECT idx, w - a * g / h AS w
  FROM scale JOIN w{k} USING (idx) JOIN g{k} USING (idx), step{k})""")
    losses = " UNION ALL ".join(f"SELECT * FROM loss{k}" for k in range(LINEAR_PASSES))
    tried = " UNION ALL ".join(f"SELECT {k} AS pass, * FROM w{k}" for k in range(LINEAR_PASSES))
    return _with(*parts) + f"""
SELECT idx, round(w, 6) AS weight FROM ({tried})
WHERE pass = (SELECT pass FROM ({losses}) ORDER BY loss, pass LIMIT 1)"""


def _landmark_sql() -> str:
    """Farthest-first: one choice after another."""
    parts = ["""
points AS MATERIALIZED (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS x,
         row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '#0'), CAST(vec_id AS VARCHAR))
           AS place
  FROM embeddings),
near0 AS MATERIALIZED (
  SELECT place, CAST('infinity' AS DOUBLE) AS near FROM points)"""]
    for k in range(LANDMARKS):
        parts.append(f"""
pick{k} AS MATERIALIZED (
  SELECT place, near, id, x FROM near{k} JOIN points USING (place)
  ORDER BY near DESC, place LIMIT 1),
near{k + 1} AS MATERIALIZED (
  SELECT n.place, CASE WHEN n.place = c.place THEN 0
                       ELSE least(n.near, list_distance(p.x, c.x) ** 2) END AS near
  FROM near{k} n JOIN points p USING (place), pick{k} c)""")
    return _with(*parts) + " UNION ALL ".join(
        f"""SELECT CAST({k} AS INTEGER) AS rank, id AS cluster_id,
                   CASE WHEN isinf(near) THEN NULL ELSE round(near, 6) END AS distance2
            FROM pick{k} WHERE near > 0"""
        for k in range(LANDMARKS)
    )


ORACLE: dict[str, str] = {
    "load_documents": _with(_CORPUS)
    + "SELECT doc_id, cluster_id, label, extracted_text FROM corpus",
    "label_and_prefix": _with(_CORPUS)
    + "SELECT doc_id, cluster_id, label, extracted_text FROM corpus WHERE label IS NOT NULL",
    "tokenize": _with(*_TOKEN_PARTS)
    + "SELECT doc_id, sent_id, pos, token, lemma, pos_tag FROM tokens",
    "token_counts": _with(*_TOKEN_PARTS, _WIDE)
    + "SELECT lemma AS term, count(*) AS n FROM wide GROUP BY lemma",
    "vocabulary": _with(*_TERM_PARTS) + "SELECT DISTINCT term FROM terms",
    "document_frequency": _with(*_TERM_PARTS)
    + "SELECT term, count(DISTINCT doc_id) AS n_docs FROM terms GROUP BY term",
    "generalize_entities": _with(*_TOKEN_PARTS)
    + r"""
SELECT doc_id, sent_id,
       CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 AS INTEGER)
         AS pos,
       token, CASE WHEN is_number THEN '-number-' ELSE lemma END AS lemma, pos_tag
FROM (SELECT *, lag(is_number, 1, false)
                  OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS after_number
      FROM (SELECT *, regexp_matches(token, '"""
    + tx.DIGITS_PATTERN
    + """') AS is_number FROM tokens))
WHERE NOT (is_number AND after_number)""",
    "phrases": _with(*_PHRASE_PARTS)
    + """SELECT doc_id, array_to_string(words, ' ') AS phrase,
                CAST(len(words) AS INTEGER) AS n_words FROM phrases""",
    "phrase_ngrams": _with(*_PHRASE_PARTS, _NGRAMS)
    + "SELECT term, count(*) AS n FROM ngrams GROUP BY term",
    "phrase_ngrams_contiguous": _with(*_PHRASE_PARTS, _CONTIGUOUS)
    + "SELECT term, count(*) AS n FROM ngrams GROUP BY term",
    "dictionary": _with(*_DICTIONARY_PARTS) + "SELECT idx, term, n FROM dictionary",
    "dictionary_by_documents": _with(*_TERM_PARTS)
    + """SELECT row_number() OVER (ORDER BY n DESC, term) - 1 AS idx, term, n
         FROM (SELECT term, count(DISTINCT doc_id) AS n FROM terms GROUP BY term)""",
    "dictionary_roundtrip": _with(*_DICTIONARY_PARTS) + "SELECT idx, term FROM dictionary",
    "dictionary_topk": _with(*_DICTIONARY_PARTS)
    + f"SELECT idx, term, n FROM dictionary WHERE idx < {TOP_TERMS}",
    "term_count_lines": _with(*_DICTIONARY_PARTS)
    + "SELECT term || chr(9) || chr(9) || n AS line FROM dictionary",
    "doc_term_vectors": _with(*_VECTOR_PARTS)
    + "SELECT doc_id, idx, value FROM doc_vectors",
    "cluster_vectors": _with(*_MAX_PARTS) + _LONG_VECTORS.format("value"),
    "cluster_vectors_sum": _with(*_VECTOR_PARTS, _entries("sum(value)"))
    + _LONG_VECTORS.format("value"),
    "cluster_vectors_avg": _with(*_VECTOR_PARTS, _entries("sum(value) / max(n_docs)"))
    + _LONG_VECTORS.format("round(value, 9)"),
    "conversation_vectors": _with(*_CONVERSATION_PARTS) + _LONG_VECTORS.format("value"),
    "explain_vector": _with(*_DICTIONARY_PARTS, _EXPLAINED)
    + """SELECT cluster_id, idx, term, CAST(merged.n AS DOUBLE) AS value
         FROM merged JOIN dictionary USING (term)""",
    "foreign_vectors": _with(*_FOREIGN_PARTS) + _LONG_VECTORS.format("value"),
    "dictionary_reverse": "SELECT source AS term, max(doc_id) AS idx FROM documents GROUP BY source",
    "cluster_sizes": """
SELECT CAST(conv_id AS VARCHAR) AS cluster_id, count(*) AS n_docs
FROM conversations GROUP BY conv_id""",
    "label_conflicts": """
SELECT source AS cluster_id, min(quality) AS min_label, max(quality) AS max_label,
       count(quality) AS n_labelled
FROM documents JOIN labels USING (doc_id) GROUP BY source
HAVING min(quality) <> max(quality)""",
    "svmlite_lines": _with(*_MAX_PARTS, _VECTOR_LINES)
    + """SELECT cluster_id,
                concat_ws(' ', coalesce(label, cluster_id), fields) AS line FROM lines""",
    "svmlite_parse": _with(*_MAX_PARTS)
    + """SELECT cluster_id, coalesce(CAST(label AS VARCHAR), cluster_id) AS first,
                CAST(idx AS INTEGER) AS idx, value
         FROM clusters LEFT JOIN entries USING (cluster_id)""",
    "vectors_roundtrip": _with(*_MAX_PARTS)
    + """SELECT cluster_id, coalesce(CAST(label AS VARCHAR), cluster_id) AS first,
                CAST(idx AS INTEGER) AS idx, value
         FROM clusters LEFT JOIN entries USING (cluster_id)""",
    "documents_roundtrip": _with(_CORPUS)
    + """SELECT CAST(doc_id AS VARCHAR) AS doc_id, cluster_id, label, extracted_text
         FROM corpus""",
    "classes_roundtrip": _with(_CORPUS)
    + "SELECT doc_id, cluster_id, label, extracted_text FROM corpus WHERE label IN (0, 1)",
    "malformed_documents": _with(_CORPUS)
    + f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, cluster_id, label, extracted_text,
                (SELECT count(*) FROM corpus WHERE doc_id % {MALFORMED} = 0) AS n_malformed
         FROM corpus WHERE doc_id % {MALFORMED} <> 0""",
    "job_counters": _with(*_TERM_PARTS)
    + """SELECT count(DISTINCT term) AS n_terms,
                (SELECT count(DISTINCT cluster_id) FROM corpus) AS n_vectors,
                (SELECT count(DISTINCT cluster_id) FROM corpus) AS n_lines FROM terms""",
    "predictions_roundtrip": _with(_SCORES)
    + """SELECT cluster_id, score, class
         FROM text_scores LEFT JOIN truth USING (cluster_id)""",
    "fused_records": _with(_SCORES)
    + """SELECT t.cluster_id,
                round(CASE WHEN i.score IS NULL THEN t.score
                           ELSE 0.5::DOUBLE * (t.score + i.score) END, 9) AS score,
                '1234567890123456789' || (doc_id % 10) AS big,
                CASE WHEN doc_id % 2 = 1 THEN 'seven' ELSE '7' END AS mixed,
                doc_id % 2 = 1 AS is_text, n_chars AS n, source, doc_id % 2 = 1 AS has_none
         FROM text_scores t LEFT JOIN image_scores i USING (cluster_id)
              JOIN documents d ON t.cluster_id = CAST(d.doc_id AS VARCHAR)""",
    "platt_fit": _platt_sql(),
    "linear_weights": _linear_sql(),
    "landmarks": _landmark_sql(),
    "model_contracts": """
SELECT CAST(vec_id AS VARCHAR) AS cluster_id, CAST(label < 5 AS INTEGER) AS label, kernel,
       true AS same_after_load, true AS sign_decides, true AS half_decides, true AS sums_to_one,
       true AS is_probability
FROM embeddings, (SELECT unnest(['linear', 'rbf', 'landmarks']) AS kernel)""",
    "max_feature_index": _with(*_MAX_PARTS)
    + """SELECT coalesce(max(idx), 0) AS max_index,
                round(CASE WHEN max(idx) > 0 THEN 1.0::DOUBLE / max(idx) ELSE 0 END, 12)
                  AS gamma FROM entries""",
    "class_distribution": _with(_CORPUS)
    + "SELECT label, count(*) AS n FROM corpus GROUP BY label",
    "train_test_split": f"""
SELECT doc_id, CASE WHEN substr(md5(doc_id || '#0'), 1, 8)
                         < '{fraction_bound(TRAIN_FRACTION)}'
                    THEN 'train' ELSE 'test' END AS part FROM documents""",
    "train_test_split_exact": f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '#0'), doc_id)
                         <= {TRAIN_ROWS} THEN 'train' ELSE 'test' END AS part
FROM documents""",
    "score_fusion": _with(_SCORES)
    + """SELECT t.cluster_id, lang,
                round(CASE WHEN i.score IS NULL THEN t.score
                           ELSE 0.5::DOUBLE * (t.score + i.score) END, 9) AS score
         FROM text_scores t LEFT JOIN image_scores i USING (cluster_id)""",
    "fusion_agreement": _with(_SCORES)
    + """SELECT count(*) AS total, count(*) FILTER (i.score IS NULL) AS missed,
                count(*) FILTER ((t.score < 0.5 AND i.score < 0.5)
                                 OR (t.score > 0.5 AND i.score > 0.5)) AS agreed
         FROM text_scores t LEFT JOIN image_scores i USING (cluster_id)""",
    "dedup_last": _with(_SCORES) + "SELECT cluster_id, score FROM image_scores",
    "submission_scores": _with(_SCORES) + "SELECT cluster_id, score FROM text_scores",
    "alignment_check": _with(_SCORES)
    + _ALIGNMENT.format("text", "text_scores")
    + " UNION ALL "
    + _ALIGNMENT.format("image", "image_records"),
    "confusion_matrix": _with(_SCORES, _ALL_PREDICTED)
    + """SELECT predicted, count(actual) FILTER (actual = '0') AS actual_0,
                count(actual) FILTER (actual = '1') AS actual_1,
                count(actual) FILTER (actual = 'other') AS actual_other,
                count(actual) FILTER (actual = 'unlabelled') AS actual_unlabelled,
                count(actual) AS predicted_total
         FROM (SELECT * FROM cells
               UNION ALL SELECT unnest(['0', '1', 'other', 'unlabelled']), NULL
               UNION ALL SELECT 'actual_total', actual FROM cells)
         GROUP BY predicted""",
    "confusion_counts": _with(_SCORES)
    + "SELECT predicted, actual, count(*) AS n FROM predicted GROUP BY CUBE (predicted, actual)",
    "error_rate": _with(_SCORES, _ALL_PREDICTED)
    + """SELECT count(*) AS total, count(actual) AS labelled,
                count(*) FILTER (predicted <> actual) AS errors,
                round(100.0::DOUBLE * count(*) FILTER (predicted <> actual) / count(actual), 9)
                  AS error_percent FROM all_predicted""",
    "roc_curve": _with(_SCORES, _ROC)
    + """SELECT score AS threshold, round(CAST(fp AS DOUBLE) / CAST(n AS DOUBLE), 9) AS fpr,
                round(CAST(tp AS DOUBLE) / CAST(p AS DOUBLE), 9) AS tpr
         FROM running, totals
         UNION ALL SELECT NULL, 0.0, 0.0""",
    "roc_auc": _with(_SCORES, _ROC)
    + """SELECT CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg,
                round(CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / 2
                      / CAST(max(p) AS DOUBLE) / CAST(max(n) AS DOUBLE), 9) AS auc
         FROM running, totals""",
    "rbf_decision": """
WITH vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x,
         CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS coef
  FROM embeddings),
width AS (SELECT 1.0::DOUBLE / (max(len(x)) - 1) AS gamma FROM vectors)
SELECT a.id, round(sum(b.coef * exp(-gamma * list_distance(a.x, b.x) ** 2)) - 0.5::DOUBLE, 6)
         AS decision
FROM vectors a, vectors b, width GROUP BY a.id""",
}
