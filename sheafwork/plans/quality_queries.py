"""Typing and quality queries over the dirty string tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions import cells as C
from sheafwork.functions.text import sanitize_ident
from sheafwork.operators import quality as Q
from sheafwork.operators import tabular as Y
from sheafwork.plans import inputs as I
from sheafwork.plans.registry import query

CELLS = I.cells_sql()
KEYS = 'source_file, table_id, col_idx, "column"'


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _q(pattern: str) -> str:
    return pattern.replace("{", "{{").replace("}", "}}").replace("'", "''")


NUMBER = _q(C.NUMBER_SHAPE)


def class_sql(v: str) -> str:
    """Null, garbage or ok for a trimmed value expression."""
    return f"""CASE WHEN lower({v}) IN {_in(C.NULL_TOKENS)} THEN 'null'
  WHEN regexp_matches({v}, '{_q(C.EXCEL_ERROR)}') OR regexp_matches({v}, '{_q(C.SYMBOL_NOISE)}')
    OR (length({v}) >= 4 AND replace(lower({v}), left(lower({v}), 1), '') = '') THEN 'garbage' ELSE 'ok' END"""


def guess_sql(name: str, n: str, numeric: str, words: str) -> str:
    """Semantic type from a name expression and counts of usable, numeric and boolean values."""
    def has(words) -> str:
        return "(" + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + ")"

    return f"""CASE WHEN regexp_matches(lower({name}), '{C.ID_NAME}') THEN 'id'
  WHEN {has(('email',))} THEN 'email' WHEN {has(('phone', 'tel'))} THEN 'phone' WHEN {has(C.DATE_NAME_WORDS)} THEN 'date'
  WHEN regexp_matches(lower({name}), '{C.BOOLEAN_NAME}') OR {has(C.BOOLEAN_NAME_WORDS)} THEN 'boolean'
  WHEN {has(C.NUMBER_NAME_WORDS)} THEN 'number'
  WHEN {n} > 0 AND {numeric} * 10 >= {n} * 8 THEN 'number'
  WHEN {n} > 0 AND {words} * 10 >= {n} * 8 THEN 'boolean' ELSE 'text' END"""


def match_sql(v: str, kind: str) -> str:
    return f"""CASE {kind} WHEN 'number' THEN regexp_matches(regexp_replace({v}, '[,$%]', '', 'g'), '{NUMBER}')
  WHEN 'email' THEN regexp_matches({v}, '{_q(C.EMAIL_SHAPE)}') WHEN 'date' THEN regexp_matches({v}, '{_q(C.DATE_SHAPE)}')
  WHEN 'phone' THEN length(regexp_replace({v}, '\\D', '', 'g')) BETWEEN 7 AND 15 ELSE true END"""


def clean_sql(v: str) -> str:
    s = f"trim({v})"
    neg = f"(starts_with({s}, '(') AND ends_with({s}, ')') AND length({s}) > 2)"
    bare = f"regexp_replace(CASE WHEN {neg} THEN substr({s}, 2, length({s}) - 2) ELSE {s} END, '[,$\\s]', '', 'g')"
    return f"CASE WHEN {neg} AND {bare} <> '' THEN concat('-', {bare}) ELSE {bare} END"


SENTINEL = f"(value IS NULL OR lower(trim(value)) IN {_in(C.NULL_SENTINELS)})"
TYPES = f"""
SELECT {KEYS}, filled, ints, reals, CASE WHEN filled = 0 THEN 'TEXT' WHEN ints * 100 >= filled * 90 THEN 'INTEGER'
  WHEN reals * 100 >= filled * 90 THEN 'REAL' ELSE 'TEXT' END AS storage_type
FROM (SELECT {KEYS}, count(*) FILTER (WHERE NOT {SENTINEL}) AS filled,
  count(*) FILTER (WHERE NOT {SENTINEL} AND regexp_matches({clean_sql('value')}, '{C.INTEGER_SHAPE}')) AS ints,
  count(*) FILTER (WHERE NOT {SENTINEL} AND regexp_matches({clean_sql('value')}, '{NUMBER}')) AS reals
  FROM ({CELLS}) GROUP BY ALL)
"""


def rate(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE ((2000 * {n} + {d}) // (2 * {d})) / CAST(1000 AS DOUBLE) END)"


def percent(n: str, d: str) -> str:
    return f"CAST(CASE WHEN {d} = 0 THEN 0 ELSE round_even(CAST(100 AS DOUBLE) * {n} / {d}, 0) END AS BIGINT)"


STYLES = ", ".join(f"count(*) FILTER (WHERE cls = 'ok' AND lower(v) IN {_in(s)}) AS s{i}" for i, s in enumerate(C.BOOLEAN_STYLES))
STATS = f"""
SELECT s.*, CASE WHEN inferred_type = 'boolean' THEN boolean_hits ELSE plain_hits END AS type_hits FROM (
  SELECT {KEYS}, inferred_type, count(*) AS n_rows, count(*) FILTER (WHERE cls = 'null') AS null_n,
    count(*) FILTER (WHERE cls = 'garbage') AS garbage_n, count(*) FILTER (WHERE cls = 'ok') AS ok_n,
    count(DISTINCT CASE WHEN cls = 'ok' THEN lower(v) END) AS distinct_n,
    greatest({", ".join(f"count(*) FILTER (WHERE cls = 'ok' AND lower(v) IN {_in(s)})" for s in C.BOOLEAN_STYLES)}) AS boolean_hits,
    count(*) FILTER (WHERE cls = 'ok' AND {match_sql('v', 'inferred_type')}) AS plain_hits,
    arg_min(v, row_id) FILTER (WHERE cls = 'ok') AS first_ok
  FROM (SELECT c.*, k.inferred_type FROM (SELECT *, trim(value) AS v, {class_sql('trim(value)')} AS cls FROM ({CELLS})) c
    JOIN (SELECT {KEYS}, {guess_sql('"column"', 'ok_n', 'num_n', 'word_n')} AS inferred_type FROM (
      SELECT {KEYS}, count(*) FILTER (WHERE cls = 'ok') AS ok_n,
        count(*) FILTER (WHERE cls = 'ok' AND regexp_matches(replace(v, ',', ''), '{NUMBER}')) AS num_n,
        count(*) FILTER (WHERE cls = 'ok' AND lower(v) IN {_in(C.BOOLEAN_WORDS)}) AS word_n FROM (
          SELECT *, trim(value) AS v, {class_sql('trim(value)')} AS cls FROM ({CELLS})) GROUP BY ALL)) k
    USING ({KEYS})) GROUP BY ALL) s
"""
ISSUES = f"""list_filter([
  CASE WHEN null_n * 100 >= n_rows * 30 THEN concat({percent('null_n', 'n_rows')}, '% empty')
       WHEN null_n * 100 >= n_rows * 10 THEN concat({percent('null_n', 'n_rows')}, '% empty (few)') END,
  CASE WHEN garbage_n * 100 >= n_rows * 5 THEN concat({percent('garbage_n', 'n_rows')}, '% unusable values') END,
  CASE WHEN ok_n >= 5 AND distinct_n = 1 THEN concat('one value only (''', first_ok, ''')')
       WHEN ok_n >= 50 AND distinct_n * 50 <= ok_n THEN 'hardly any different values' END,
  CASE WHEN ok_n >= 3 AND type_hits * 100 < ok_n * 85 THEN
    concat({percent('(ok_n - type_hits)', 'ok_n')}, '% of values are not of type ''', inferred_type, '''') END],
  lambda i: i IS NOT NULL)"""
QUALITY = f"""
SELECT {KEYS}, inferred_type, n_rows, {rate('null_n', 'n_rows')} AS null_rate, {rate('garbage_n', 'n_rows')} AS garbage_rate,
  {rate('distinct_n', 'ok_n')} AS distinct_ratio, CASE WHEN ok_n = 0 THEN 1.0 ELSE {rate('type_hits', 'ok_n')} END AS type_consistency,
  {ISSUES} AS issues FROM ({STATS})
"""


@query("Y1", """
SELECT DISTINCT raw, CASE WHEN regexp_matches(s, '^[0-9]') THEN left(concat('_', s), 60) ELSE left(s, 60) END AS ident FROM (
  SELECT raw, CASE WHEN s = '' THEN 'col_0' ELSE s END AS s FROM (SELECT raw, regexp_replace(regexp_replace(
    regexp_replace(trim(raw), '[^0-9a-zA-Z_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS s
  FROM (SELECT text AS raw FROM {documents} UNION ALL SELECT CAST(doc_id AS STRING) FROM {documents})))
""")
def sanitize_identifiers(t):
    raw = t.sql("SELECT text AS raw FROM {documents} UNION ALL SELECT CAST(doc_id AS STRING) FROM {documents}")
    return raw.distinct().select("raw", sanitize_ident(F.col("raw"), F.lit("col_0")).alias("ident"))


_NAMES = """SELECT o_custkey AS table_id, lower(o_orderstatus) AS name, o_orderkey AS position FROM {orders}"""


@query("Y2", f"""
SELECT table_id, name, position, CASE WHEN n = 0 THEN name ELSE concat(name, '_', n) END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY position) - 1 AS n FROM ({_NAMES}))
""")
def dedupe_names(t):
    return Y.dedupe_names(t.sql(_NAMES), ["table_id"])


@query("Y3, Y4", f"SELECT table_id, col_idx, row_id, {SENTINEL} AS is_null, {clean_sql('value')} AS cleaned FROM ({CELLS})")
def clean_cells(t):
    v = F.col("value")
    return I.cells(t).select("table_id", "col_idx", "row_id", C.is_null_sentinel(v).alias("is_null"),
                             C.clean_numeric(v).alias("cleaned"))


@query("Y5", TYPES)
def infer_types(t):
    return Y.infer_types(I.cells(t))


def _typed(column: str, kind: str) -> str:
    live = f"CASE WHEN lower(trim({column})) NOT IN {_in(C.NULL_SENTINELS)} THEN {column} END"
    return live if kind == "TEXT" else f"TRY_CAST({clean_sql(live)} AS {'BIGINT' if kind == 'INTEGER' else 'DOUBLE'})"


_TYPED = "SELECT row_id, " + ", ".join(f"{_typed(c, k)} AS {c}" for c, k in (
    ("cust_id", "INTEGER"), ("full_name", "TEXT"), ("acct_value", "REAL"), ("segment", "TEXT"), ("is_active", "TEXT"), ("email", "TEXT"),
    ("origin", "TEXT"), ("phone", "INTEGER"))) + f" FROM ({I.CUSTOMER_TABLE})"


@query("Y5, Y6", _TYPED)
def type_table(t):
    wide = t.sql(I.CUSTOMER_TABLE)
    columns = [c for c in wide.columns if c != "row_id"]
    found = Y.infer_types(Y.unpivot_cells(wide, "customers.csv", "customers", "row_id", columns))
    return Y.type_table(wide, {r.column: r.storage_type for r in found.select("column", "storage_type").collect()})


@query("Y6", f"""
SELECT table_id, col_idx, row_id, value, storage_type FROM ({CELLS}) JOIN ({TYPES}) USING (source_file, table_id, col_idx)
WHERE NOT {SENTINEL} AND ((storage_type = 'INTEGER' AND NOT regexp_matches({clean_sql('value')}, '{C.INTEGER_SHAPE}'))
  OR (storage_type = 'REAL' AND NOT regexp_matches({clean_sql('value')}, '{NUMBER}')))
""")
def typing_rejects(t):
    cells = I.cells(t)
    return Y.rejects(cells, Y.infer_types(cells)).select("table_id", "col_idx", "row_id", "value", "storage_type")


_LISTED = f"""
SELECT path AS source_file, CAST(NULL AS STRING) AS sheet, ordinal, CAST(ordinal % 3 AS INT) AS n_columns, ordinal % 5 AS n_rows
FROM ({I.LISTING})
UNION ALL SELECT concat('book_', CAST(s_nationkey AS STRING), '.xlsx'), concat('Sheet ', CAST(s_suppkey % 2 AS STRING)),
  1000000000 + s_suppkey, 3, CAST(9 AS BIGINT) FROM {{supplier}}
"""


@query("Y7, Y8", f"""
WITH u AS (SELECT * FROM ({_LISTED}) WHERE n_columns > 0 AND n_rows > 0),
s AS (SELECT *, regexp_extract(source_file, '([^/]*)$', 1) AS b FROM u),
n AS (SELECT *, lower(CASE WHEN regexp_matches(b, '^.+[.][^.]*$') THEN regexp_extract(b, '^(.+)[.][^.]*$', 1) ELSE b END) AS stem FROM s),
i AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(CASE WHEN coalesce(sheet, '') <> '' THEN concat(stem, '_', sheet) ELSE stem END,
  '[^0-9a-zA-Z_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS raw FROM n),
f AS (SELECT *, left(CASE WHEN raw = '' THEN 'table' WHEN regexp_matches(raw, '^[0-9]') THEN concat('_', raw) ELSE raw END, 60) AS base_name FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY ordinal) AS k FROM f)
SELECT source_file, ordinal, CASE WHEN k = 1 THEN base_name ELSE concat(left(base_name, 55), '_', k) END AS table_name FROM r
""")
def table_names(t):
    return Y.table_names(Y.usable(t.sql(_LISTED))).select("source_file", "ordinal", "table_name")


@query("Q1", f"SELECT table_id, col_idx, value, {class_sql('trim(value)')} AS cell_class, count(*) AS n FROM ({CELLS}) GROUP BY ALL")
def classify_cells(t):
    cells = I.cells(t).groupBy("table_id", "col_idx", "value").agg(F.count("*").alias("n"))
    return cells.select("table_id", "col_idx", "value", C.classify_cell(F.col("value")).alias("cell_class"), "n")


@query("Q2, Q3, Q4", f"SELECT {KEYS}, inferred_type, ok_n, distinct_n, boolean_hits, type_hits FROM ({STATS})")
def column_type_stats(t):
    return Q.column_stats(I.cells(t)).select(*Q.KEYS, "inferred_type", "ok_n", "distinct_n", "boolean_hits", "type_hits")


@query("Q5, Q6", f"SELECT * EXCLUDE (issues), array_to_string(issues, '; ') AS issues FROM ({QUALITY})")
def column_quality(t):
    return Q.column_quality(Q.column_stats(I.cells(t))).withColumn("issues", F.array_join("issues", "; "))


def _dup_sql(sql: str, columns) -> str:
    key = ", ".join(f"lower(trim(coalesce(CAST({c} AS STRING), '')))" for c in columns)
    return f"""SELECT row_count, duplicate_rows, {rate('duplicate_rows', 'row_count')} AS duplicate_rate FROM (
  SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) FILTER (WHERE NOT blank) AS BIGINT) AS duplicate_rows FROM (
    SELECT count(*) AS n, concat({key}) = '' AS blank FROM ({sql}) GROUP BY {key}))"""


_LINES = "SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM {lineitem}"
_LINE_COLS = ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")


@query("Q7", _dup_sql(_LINES, _LINE_COLS))
def duplicate_rows(t):
    rows = t.sql(_LINES).withColumn("table_id", F.lit("lineitem"))
    return Q.duplicate_rows(rows, list(_LINE_COLS), ["table_id"]).drop("table_id")


FINDINGS = f"""
WITH q AS ({QUALITY}), i AS (SELECT *, unnest(range(1, len(issues) + 1)) AS k FROM q), c AS (
  SELECT source_file, table_id, col_idx, k - 1 AS issue_no, concat(table_id, '.', "column", ': ', issues[k]) AS message,
    CASE WHEN contains(issues[k], 'empty (few)') THEN 1.5 WHEN contains(issues[k], 'empty') THEN 4 + null_rate * 8
      WHEN contains(issues[k], 'unusable values') THEN 5 + garbage_rate * 15
      WHEN contains(issues[k], 'one value only') OR contains(issues[k], 'hardly any different') THEN 3.0
      ELSE 4 + (1 - type_consistency) * 8 END AS severity FROM i)
SELECT source_file, table_id, col_idx, issue_no, message, CAST(severity AS DOUBLE) AS severity FROM c
UNION ALL
SELECT 'erp/parts.csv', 'parts', -1, 0, concat('parts: ', duplicate_rows, ' repeated rows (',
  CAST(round_even(duplicate_rate * 100, 0) AS INT), '%)'), 8 + least(duplicate_rate, 1.0) * 12
FROM ({_dup_sql(I.PART_TABLE, ('product_name', 'brand', 'category'))}) WHERE duplicate_rate >= 0.05
"""


def _findings(t):
    quality = Q.column_quality(Q.column_stats(I.cells(t)))
    parts = t.sql(I.PART_TABLE).withColumn("source_file", F.lit("erp/parts.csv")).withColumn("table_id", F.lit("parts"))
    dup = Q.duplicate_rows(parts, ["product_name", "brand", "category"], ["source_file", "table_id"])
    return Q.table_findings(quality, dup)


@query("Q8", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY severity DESC, table_id, col_idx, issue_no) AS rn FROM ({FINDINGS}))
SELECT source_file, least(CAST(sum(severity) AS DOUBLE), 40.0) AS penalty, count(*) AS findings,
  string_agg(message, ' | ' ORDER BY rn) AS messages
FROM f GROUP BY source_file
""")
def table_penalty(t):
    return Q.table_penalty(_findings(t)).withColumn("messages", F.array_join("messages", " | "))


_SCORED = f"""
SELECT concat(source, '/doc_', CAST(doc_id AS STRING)) AS source_file,
  CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'media' ELSE 'image' END AS category,
  CAST(doc_id % 7 AS INT) AS errors, doc_id % 11 = 0 AS unreachable,
  CASE WHEN doc_id % 3 = 0 THEN CAST(50 + doc_id % 50 AS DOUBLE) / 100 END AS ocr_confidence,
  doc_id % 5 <> 0 AS text_present, doc_id % 2 AS n_tables, doc_id % 6 AS yielded,
  CAST(doc_id % 45 AS DOUBLE) AS penalty FROM {{documents}}
"""


@query("Q9, Q10", f"""
WITH s AS (SELECT source_file, greatest(0.0, least(100.0, 100.0 - least(errors * 12, 60)
  - CASE WHEN coalesce(ocr_confidence, 1.0) < 0.70 THEN 20 WHEN coalesce(ocr_confidence, 1.0) < 0.85 THEN 8 ELSE 0 END
  - CASE WHEN NOT text_present AND n_tables = 0 THEN 30
         WHEN text_present AND category IN {_in(Q.EXTRACTION_EXPECTED)} AND yielded = 0 AND NOT unreachable THEN 15 ELSE 0 END
  - penalty)) AS s FROM ({_SCORED}))
SELECT source_file, round(s, 1) AS score, CASE WHEN s >= 90 THEN 'Complete' WHEN s >= 70 THEN 'Minor gaps'
  WHEN s >= 40 THEN 'Partial' ELSE 'Severely degraded' END AS completeness FROM s
""")
def file_quality(t):
    return Q.file_quality(t.sql(_SCORED))


@query("Q10", f"""
SELECT {KEYS}, CASE WHEN null_rate >= 0.3 THEN 'bad' WHEN null_rate >= 0.1 THEN 'warn' ELSE 'ok' END AS null_band FROM ({QUALITY})
""")
def quality_bands(t):
    quality = Q.column_quality(Q.column_stats(I.cells(t)))
    return quality.select(*Q.KEYS, Q.cell_band(F.col("null_rate")).alias("null_band"))
