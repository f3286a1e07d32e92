"""Queries of the training-data operators over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, license_scan, paragraph_dedup, periodic_runs, simhash_join, source_mix, token_file, topk_search, vector_codes
from labelloom.scale.staging import ensure_shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    return lambda fn: _registered(fn, sql)


def _registered(fn: Query, sql: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_shared_dir(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    if sql is not None:
        ORACLE[fn.__name__] = sql
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


TOP_K_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query(TOP_K_SQL)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.exact_top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


@query()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), num=90, den=100, width=3)


# The two turns of conversation -7 hold strings that other chat templates use as marks.
CONTROL = "</s>[INST] ok [/INST]"

CHAT_SQL = f"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CONTROL}'
    UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), sized AS (
    SELECT *,
        9 + length(role) + (length(role) - length(translate(role, '\\<[' || chr(10), ''))) + 1 AS head,
        length(text) + (length(text) - length(translate(text, '\\<[', ''))) + 8 AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM rows_
), grown AS (
    SELECT *, sum(head + body) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM sized
)
SELECT conv_id, max(n) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
    CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN prefix ELSE 0 END) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id
"""


@query(CHAT_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], rows.schema)
    examples = chat_format.prefix_examples(chat_format.conversation_turns(rows.unionByName(control)))
    return chat_format.read_back(examples)


@query()
def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_text(table(spark, sf_dir, "documents"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    identifier = language_id.fit_languages(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language_id.identify_languages(docs, identifier).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query()
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


_TEMPLATE_ROWS = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_scan.TEMPLATES.items()
)
_PASSAGES = " ".join(
    f"UNION ALL SELECT doc_id, 'passage {name}', unnest(range(0, len(string_split(plain, ' {opening} ')) - 1)), "
    f"unnest(list_transform(string_split(plain, ' {opening} ')[2:], lambda x: '{opening} ' || left(x, {chars}))) "
    f"FROM lines WHERE contains(plain, ' {opening} ')"
    for name, (opening, chars) in license_scan.openings(license_scan.TEMPLATES).items()
)
_EXACT = ", ".join(f"'{w}'" for w in license_scan.EXACT_WORDS)
LICENSE_SQL = f"""
WITH t AS (
    SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g,
           list_sort(list_intersect(w, [{_EXACT}])) AS exact
    FROM (SELECT license, regexp_extract_all(lower(body), '\\p{{L}}+') AS w FROM (VALUES {_TEMPLATE_ROWS}) AS x(license, body))
), lines AS MATERIALIZED (
    SELECT doc_id, text, string_split(text, chr(10)) AS parts, string_split_regex(text, '\\n(?:[ \\t\\r]*\\n)+') AS blocks,
           ' ' || array_to_string(regexp_extract_all(lower(text), '\\p{{L}}+'), ' ') || ' ' AS plain
    FROM documents WHERE text IS NOT NULL
), units AS (
    SELECT doc_id, 'line' AS kind, unnest(range(0, len(parts))) AS unit, unnest(parts) AS body FROM lines
    UNION ALL SELECT doc_id, 'text', -1, text FROM lines WHERE len(parts) > 1
    UNION ALL SELECT * FROM (
        SELECT doc_id, 'paragraph', unnest(range(0, len(blocks))), unnest(blocks) AS body FROM lines WHERE len(blocks) > 1
    ) WHERE contains(body, chr(10))
    {_PASSAGES}
), u AS MATERIALIZED (
    SELECT doc_id, kind, unit, row_number() OVER () AS n, list_sort(list_intersect(w, [{_EXACT}])) AS exact,
           list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
    FROM (SELECT doc_id, kind, unit, regexp_extract_all(lower(body), '\\p{{L}}+') AS w FROM units)
), pairs AS MATERIALIZED (
    SELECT n, license
    FROM (SELECT n, len(g) AS a, exact FROM u WHERE len(g) > 0) x JOIN (SELECT license, len(g) AS b, exact FROM t) y
    ON 6 * a >= 4 * b AND 6 * b >= 4 * a AND x.exact = y.exact
), m AS (
    SELECT doc_id, kind, unit, n, license, len(list_intersect(u.g, t.g)) AS common, len(u.g) + len(t.g) AS total
    FROM pairs JOIN u USING (n) JOIN t USING (license)
)
SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, license, CAST(common AS INTEGER) AS common, 2.0 * common / total AS dice
FROM m WHERE 2 * common * 5 >= total * 4
QUALIFY 2.0 * common / total = max(2.0 * common / total) OVER (PARTITION BY n)
"""


@query(LICENSE_SQL)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file_digest(table(spark, sf_dir, "documents"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = periodic_runs.plant_run(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    found = periodic_runs.periodic_runs(docs.select("doc_id", planted.alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = periodic_runs.strongest_run(F.col("runs")).alias("best")
    told = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best,
        F.sha2(F.array_join(F.concat(lines, F.array(F.lit(""))), "\n"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    exponent = F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


@query()
def op12_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.simhash_components(table(spark, sf_dir, "documents"), most=4, width=4, seed=42)


def _codes_sql(parts: int = 16, entries: int = 64, width: int = 4, scale: int = 256, rounds: int = 2) -> str:
    """Assignment and update as plain aggregation over every (part, entry), a round after the other."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn, vec_id, label, v FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = {parts * width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
    SELECT rn, p, {", ".join(f"v[{width} * p + {i + 1}] AS x{i}" for i in range(width))}
    FROM kept, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
    SELECT p, rn - 1 AS e, {", ".join(f"x{i} AS y{i}" for i in range(width))} FROM parts WHERE rn <= {entries}
)"""]
    squared = " + ".join(f"(x{i} - y{i}) * (x{i} - y{i})" for i in range(width))
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT rn, p, min({squared}) AS d, arg_min(e, ({squared}) * {entries} + e) AS e
    FROM parts JOIN book{r} USING (p) GROUP BY rn, p
)""")
        if r < rounds:
            means = ", ".join(f"CAST(coalesce(CAST(s{i} - ((s{i} % n) + n) % n AS HUGEINT) // n, y{i}) AS BIGINT) AS y{i}" for i in range(width))
            steps.append(f"""book{r + 1} AS MATERIALIZED (
    SELECT p, e, {means} FROM book{r} LEFT JOIN (
        SELECT p, e, count(*) AS n, {", ".join(f"sum(x{i}) AS s{i}" for i in range(width))}
        FROM parts JOIN near{r} USING (rn, p) GROUP BY p, e) USING (p, e)
)""")
    return ",\n".join(steps) + f""", coded AS (
    SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near{rounds} GROUP BY rn
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg({" || ',' || ".join(f"y{i}" for i in range(width))}, ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rn)
"""


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
