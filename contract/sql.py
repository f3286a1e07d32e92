"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from contract.tables import SUFFIX

# Every character that counts as whitespace, spelled out because regex engines disagree on \s.
SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUOTED_SUFFIX = SUFFIX.replace("'", "''")
MARKED = f"text || '{QUOTED_SUFFIX}'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def text_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{SPACE}+', ' ', 'g'))"


def _cleaned(x: str, anon: str, number: str, dropped: str) -> str:
    step = f"regexp_replace(lower({x}), '\\bx{{2,}}\\b', '{anon}', 'g')"
    step = f"regexp_replace({step}, '[0-9]+', '{number}', 'g')"
    return f"trim(regexp_replace({step}, '{dropped}', ' ', 'g'))"


def tfidf_clean(x: str) -> str:
    return _cleaned(x, " ", " num ", "[^a-z]+")


def neural_clean(x: str) -> str:
    return _cleaned(x, " <anon> ", " <num> ", "[^a-z<>'']+")


def words(x: str, least: int = 1) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: length(w) >= {least})"


def bigrams(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


# documents after the null and length filters
BASE = f"""
base AS (
  SELECT doc_id AS record_id, text, lang AS product, source AS issue, lang || '|' || source AS category,
         {text_key('text')} AS text_key
  FROM documents
  WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND length({strip('text')}) > 20
)"""

CHAIN = BASE + """,
in_class AS (
  SELECT * FROM base WHERE category IN (SELECT category FROM base GROUP BY category HAVING count(*) >= 5)
),
conflicts AS (
  SELECT text_key, count(*) AS key_rows, min(category) AS first_category, max(category) AS last_category
  FROM in_class GROUP BY text_key HAVING count(DISTINCT category) > 1
),
clean AS (SELECT * FROM in_class WHERE text_key NOT IN (SELECT text_key FROM conflicts)),
refiltered AS (
  SELECT * FROM clean WHERE category IN (SELECT category FROM clean GROUP BY category HAVING count(*) >= 5)
)"""

GROUPED = CHAIN + """,
key_groups AS (
  SELECT sha256(text_key) AS key_digest, min(category) AS category, count(*) AS key_rows
  FROM refiltered GROUP BY text_key
),
dealt AS (
  SELECT *, CAST('0x' || substr(md5(category), 1, 4) AS BIGINT) % 5 AS start,
         row_number() OVER (
           PARTITION BY category ORDER BY key_rows DESC, md5('42|' || key_digest), key_digest) - 1 AS rnk
  FROM key_groups
),
folds AS (SELECT key_digest, category, key_rows, start, (rnk + start) % 5 AS fold FROM dealt),
second_deal AS (
  SELECT key_digest,
         (row_number() OVER (
            PARTITION BY category ORDER BY key_rows DESC, md5('42|' || key_digest), key_digest) - 1 + start) % 5
           AS fold
  FROM folds WHERE fold <> 0
),
group_splits AS (
  SELECT f.key_digest,
         CASE WHEN f.fold = 0 THEN 'test' WHEN s.fold = 0 THEN 'val' ELSE 'train' END AS split
  FROM folds f LEFT JOIN second_deal s USING (key_digest)
)"""

PREPARED = GROUPED + """,
prepared AS MATERIALIZED (
  SELECT r.*, sha256(r.text_key) AS key_digest, g.split,
         'cfpb_' || CAST(row_number() OVER (ORDER BY r.record_id) - 1 AS VARCHAR) AS complaint_id
  FROM refiltered r JOIN group_splits g ON g.key_digest = sha256(r.text_key)
)"""

LABELS = PREPARED + """,
labels_by_id AS (
  SELECT category, row_number() OVER (ORDER BY category) - 1 AS label_id
  FROM (SELECT DISTINCT category FROM prepared WHERE split = 'train')
)"""

PREDICTIONS = LABELS + """,
scored AS (
  SELECT p.record_id, p.text, p.category AS y_true, l.label_id,
         list_transform(range((SELECT count(*) FROM labels_by_id)), lambda j:
           CAST('0x' || substr(md5(CAST(p.record_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 6) AS BIGINT)
             / 16777216e0 + CASE WHEN j = l.label_id THEN 0.5e0 ELSE 0e0 END) AS scores
  FROM prepared p JOIN labels_by_id l USING (category)
),
predictions AS MATERIALIZED (
  SELECT s.*, l.category AS y_pred,
         list_transform(s.scores, lambda x: exp(x - list_max(s.scores))
           / list_sum(list_transform(s.scores, lambda y: exp(y - list_max(s.scores))))) AS proba
  FROM scored s JOIN labels_by_id l ON l.label_id = list_position(s.scores, list_max(s.scores)) - 1
)"""

METRICS = PREDICTIONS + """,
sides AS (
  SELECT y_true AS category, CAST(y_true = y_pred AS BIGINT) AS tp, 1 AS support, 0 AS said FROM predictions
  UNION ALL SELECT y_pred, 0, 0, 1 FROM predictions
),
counts AS (
  SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(said) - sum(tp) AS BIGINT) AS fp,
         CAST(sum(support) - sum(tp) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support
  FROM sides GROUP BY category
),
metrics AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1
  FROM counts
)"""

_GROUP_CTES = """,
train_counts AS (SELECT category, count(*) AS train_count FROM prepared WHERE split = 'train' GROUP BY category),
border AS (SELECT CAST(ceil(avg(train_count)) AS BIGINT) AS m FROM train_counts),
class_groups AS (
  SELECT category, train_count,
         CASE WHEN train_count >= ceil(1.5 * m) THEN 'head' WHEN train_count >= m THEN 'mid'
              WHEN train_count <= m - 2 THEN 'tail' ELSE 'mid' END AS class_group
  FROM train_counts, border
)"""
FREQUENCY = PREPARED + _GROUP_CTES
GROUP_METRICS = METRICS + _GROUP_CTES

TAIL = GROUP_METRICS + """,
tail AS (SELECT category, train_count FROM train_counts, border WHERE train_count < m),
tail_metrics AS (
  SELECT t.category, coalesce(c.support, 0) AS support_test, coalesce(c.precision, 0e0) AS precision,
         coalesce(c.recall, 0e0) AS recall, coalesce(c.f1, 0e0) AS f1, coalesce(c.fn, 0) AS fn_count,
         coalesce(c.fp, 0) AS fp_count
  FROM tail t LEFT JOIN metrics c USING (category)
),
worst AS (
  SELECT * FROM tail_metrics WHERE support_test > 0 ORDER BY f1, support_test DESC, category LIMIT 20
)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def terms(source: str, ngrams: bool = True) -> str:
    """CTE body: (record_id, split, terms) of TF-IDF terms."""
    cleaned = words(tfidf_clean("text"), 2)
    listed = bigrams("t") if ngrams else "t"
    return f"SELECT record_id, split, {listed} AS terms FROM (SELECT record_id, split, {cleaned} AS t FROM {source})"


def vocab_ctes(max_features: int | None = 50_000, ngrams: bool = True) -> str:
    """Vocabulary fitted on the training rows, with n, df, cf, idf and alphabetical ids."""
    limit = "" if max_features is None else f"LIMIT {max_features}"
    return PREPARED + f""",
doc_terms AS MATERIALIZED ({terms('prepared', ngrams)}),
occurrences AS MATERIALIZED (SELECT record_id, split, unnest(terms) AS term FROM doc_terms),
tf AS MATERIALIZED (SELECT record_id, split, term, count(*) AS tf FROM occurrences GROUP BY ALL),
n_train AS (SELECT count(*) AS n FROM prepared WHERE split = 'train'),
stats AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf WHERE split = 'train' GROUP BY term
),
kept AS (
  SELECT term, df, cf FROM stats, n_train WHERE df >= 2 AND df <= 0.95e0 * n
  ORDER BY cf DESC, term {limit}
),
vocab AS MATERIALIZED (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, cf,
         ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf
  FROM kept, n_train
),
raw_weights AS (
  SELECT t.record_id, t.split, v.term, v.term_id, (1e0 + ln(t.tf)) * v.idf AS raw FROM tf t JOIN vocab v USING (term)
),
weights AS MATERIALIZED (
  SELECT record_id, split, term, term_id,
         raw / sqrt(sum(raw * raw) OVER (PARTITION BY record_id)) AS weight
  FROM raw_weights
)"""


def token_ctes(max_size: int = 50_000) -> str:
    """Tokens of the marked prepared texts and the vocabulary fitted on train."""
    return PREPARED + f""",
doc_tokens AS MATERIALIZED (
  SELECT record_id, split, {words(neural_clean(MARKED))} AS tokens FROM prepared
),
token_freq AS (
  SELECT token, count(*) AS freq
  FROM (SELECT unnest(tokens) AS token FROM doc_tokens WHERE split = 'train') GROUP BY token
),
token_vocab AS MATERIALIZED (
  SELECT '<pad>' AS token, 0 AS token_id, 0 AS freq UNION ALL SELECT '<unk>', 1, 0 UNION ALL
  SELECT token, row_number() OVER (ORDER BY freq DESC, token) + 1, freq FROM (
    SELECT token, freq FROM token_freq WHERE freq >= 2 AND token NOT IN ('<pad>', '<unk>')
    ORDER BY freq DESC, token LIMIT {max_size - 2})
)"""
