"""Inputs derived from the given tables, written once in SQL that both engines read.

Dirt is put into cell values by key, candidate identifiers are built from keys, and the star tables
play the parts of files, entities, relations, findings and facts. Every statement covers the whole
table it reads.
"""

from __future__ import annotations

K = "CAST({0} AS STRING)"


def digits(expr: str, n: int) -> str:
    """n digits from a key, spread by a prime."""
    return f"lpad(CAST(({expr}) % {10 ** n} AS STRING), {n}, '0')"


def month_file(date: str = "o_orderdate") -> str:
    return (f"concat('orders/', CAST(year({date}) AS STRING), '-', "
            f"lpad(CAST(month({date}) AS STRING), 2, '0'), '.csv')")


_c = digits("o_orderkey * 982451653", 15)
_a = digits("o_orderkey * 49979687 + 17", 11)
_f = digits("o_orderkey * 7919 + 529982247", 9)
_s = digits("o_orderkey * 15485863 + 5", 9)
_p = digits("o_orderkey * 7919 + 898902", 9)

NOTES = f"""
SELECT concat('notes/', CAST(o_orderkey AS STRING), '.txt') AS source_file,
  concat('Order ', CAST(o_orderkey AS STRING), ' was paid.', chr(10),
    'P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<', chr(10),
    {_p}, CAST(o_orderkey % 10 AS STRING), 'UTO7408122F1204159ZE184226B<<<<<10', chr(10),
    'Card 4', {_c}, ' or 5', substr({_c}, 1, 3), '-', substr({_c}, 4, 4), '-', substr({_c}, 8, 4), '-',
    substr({_c}, 12, 4), ' thanks.', chr(10),
    'IBAN DE', {digits("o_orderkey", 2)}, ' ', substr({_c}, 1, 4), ' ', substr({_c}, 5, 4), ' ', substr({_c}, 9, 4), ' ',
    substr({_c}, 12, 4), ' 02', chr(10),
    'Aadhaar 2', substr({_a}, 1, 3), ' ', substr({_a}, 4, 4), ' ', substr({_a}, 8, 4), '; cpf ',
    substr({_f}, 1, 3), '.', substr({_f}, 4, 3), '.', substr({_f}, 7, 3), '-', {digits("o_orderkey * 31", 2)}, '; sin ',
    substr({_s}, 1, 3), ' ', substr({_s}, 4, 3), '-', substr({_s}, 7, 3), '.', chr(10),
    'za ', {digits("o_orderkey", 2)}, lpad(CAST(o_orderkey % 13 AS STRING), 2, '0'), lpad(CAST(o_orderkey % 30 + 1 AS STRING), 2, '0'),
    {digits("o_orderkey * 13", 4)}, CAST(o_orderkey % 3 AS STRING), '8', CAST(o_orderkey * 7 % 10 AS STRING), '; cn ',
    substr({_c}, 1, 15), '07', CASE WHEN o_orderkey % 11 = 10 THEN 'x' ELSE CAST(o_orderkey % 11 AS STRING) END, chr(10),
    'ssn ', {digits("o_orderkey * 37", 3)}, '-', {digits("o_orderkey", 2)}, '-', {digits("o_orderkey * 3", 4)},
    '; eid 784-19', {digits("o_orderkey", 2)}, '-', {digits("o_orderkey * 104729", 7)}, '-', CAST(o_orderkey % 10 AS STRING)
  ) AS text
FROM {{orders}}
"""

DOC_TEXTS = """
SELECT concat(source, '/doc_', CAST(doc_id AS STRING), '.txt') AS source_file, text FROM {documents}
"""

CORPUS = f"{DOC_TEXTS} UNION ALL {NOTES}"


def corpus(t):
    """All documents and notes. Notes are many times longer than the keys they are made of, so the keys are dealt out first."""
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    keys = t.orders.select("o_orderkey").repartition(tasks)
    return t.sql(DOC_TEXTS).unionByName(t.spark.sql(NOTES, orders=keys))

# A listing of files: suffix and name word by key.
LISTING = """
SELECT concat(source, '/', CASE doc_id % 9 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'audit_report' WHEN 2 THEN 'calendar'
    WHEN 3 THEN 'Payroll-Tax-Ledger-board' WHEN 4 THEN 'photo' ELSE 'notes' END, '_', CAST(doc_id AS STRING),
    CASE doc_id % 23 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.csv' WHEN 3 THEN '.tsv' WHEN 4 THEN '.jsonl'
    WHEN 5 THEN '.xlsx' WHEN 6 THEN '.docx' WHEN 7 THEN '.eml' WHEN 8 THEN '.py' WHEN 9 THEN '.tar.gz' WHEN 10 THEN '.sqlite'
    WHEN 11 THEN '.mp4' WHEN 12 THEN '.html' WHEN 13 THEN '.gif' WHEN 14 THEN '.css' WHEN 15 THEN '' WHEN 16 THEN '.bin'
    WHEN 17 THEN '.rar' WHEN 18 THEN '.msg' WHEN 19 THEN '.ods' ELSE '.txt' END) AS path,
  CASE WHEN doc_id % 31 = 0 THEN CAST(NULL AS BIGINT) ELSE n_chars * n_chars END AS size_bytes,
  doc_id AS ordinal
FROM {documents}
"""

# Star tables as dirty string tables.
CUSTOMER_TABLE = """
SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 17 = 0 THEN 'N/A' ELSE CAST(c_custkey AS STRING) END AS cust_id,
  CASE WHEN c_custkey % 5 = 0 THEN concat(' ', upper(c_name), ' ') ELSE c_name END AS full_name,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN '####' ELSE CAST(c_acctbal AS STRING) END AS acct_value,
  CASE WHEN c_custkey % 6 = 0 THEN 'none' ELSE c_mktsegment END AS segment,
  CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'yes' WHEN 2 THEN 'False' ELSE '1' END AS is_active,
  concat(lower(c_mktsegment), CAST(c_custkey AS STRING), CASE WHEN c_custkey % 9 = 0 THEN ' at ' ELSE '@' END, 'example.com') AS email,
  'const' AS origin,
  concat('+1 555 ', lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 4 END, '0')) AS phone
FROM {customer}
"""
ORDERS_TABLE = """
SELECT o_orderkey AS row_id,
  CAST(o_orderkey AS STRING) AS OrderID,
  CASE WHEN o_orderkey % 19 = 0 THEN 'null' ELSE CAST(o_custkey AS STRING) END AS CustomerID,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('(', CAST(o_totalprice AS STRING), ')')
       WHEN o_orderkey % 29 = 0 THEN '#REF!' WHEN o_orderkey % 31 = 0 THEN 'five'
       ELSE concat('$ ', CAST(o_totalprice AS STRING)) END AS total_amount,
  CASE WHEN o_orderkey % 41 = 0 THEN 'xxxx' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'soon'
       ELSE concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING))
       END AS order_date,
  o_orderpriority AS priority
FROM {orders}
"""
PART_TABLE = """
SELECT p_partkey AS row_id, CAST(p_partkey AS STRING) AS product_id, p_name AS product_name, p_brand AS brand,
  CAST(p_size AS STRING) AS size_no, CAST(p_retailprice AS STRING) AS retail_price, p_type AS category
FROM {part}
"""
SUPPLIER_TABLE = """
SELECT s_suppkey AS row_id, CAST(s_suppkey AS STRING) AS vendor_id, s_name AS vendor_name,
  CAST(s_nationkey AS STRING) AS nation, CAST(s_acctbal AS STRING) AS balance
FROM {supplier}
"""
# table name -> (source file, table id, table number, statement, columns)
USER_TABLES = {
    "customer": ("crm/customers.csv", "customers", 0, CUSTOMER_TABLE,
                 ("cust_id", "full_name", "acct_value", "segment", "is_active", "email", "origin", "phone")),
    "orders": ("erp/orders.csv", "orders", 1, ORDERS_TABLE,
               ("OrderID", "CustomerID", "total_amount", "status", "order_date", "priority")),
    "part": ("erp/parts.csv", "parts", 2, PART_TABLE,
             ("product_id", "product_name", "brand", "size_no", "retail_price", "category")),
    "supplier": ("erp/vendors.csv", "vendors", 3, SUPPLIER_TABLE,
                 ("vendor_id", "vendor_name", "nation", "balance")),
}


def cells_sql() -> str:
    """Long cells of all user tables, for DuckDB."""
    parts = [
        f"SELECT '{f}' AS source_file, '{t}' AS table_id, {no} AS table_no, 'csv' AS category, row_id, {i} AS col_idx, "
        f"'{c}' AS \"column\", {c} AS value FROM ({sql})"
        for f, t, no, sql, cols in USER_TABLES.values() for i, c in enumerate(cols)
    ]
    return " UNION ALL ".join(parts)


def tables_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS source_file, '{t}' AS table_id, {no} AS table_no, 'csv' AS category, "
        f"(SELECT count(*) FROM {{{name}}}) AS n_rows" for name, (f, t, no, _, _) in USER_TABLES.items())


def cells(tables):
    """Long cells of all user tables, in Spark."""
    from functools import reduce

    from pyspark.sql import functions as F

    from sheafwork.operators.tabular import unpivot_cells

    parts = [
        unpivot_cells(tables.sql(sql), f, t, "row_id", list(cols)).withColumn("table_no", F.lit(no))
        for f, t, no, sql, cols in USER_TABLES.values()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def user_tables(tables):
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [
        getattr(tables, name).agg(F.count("*").alias("n_rows")).select(
            F.lit(f).alias("source_file"), F.lit(t).alias("table_id"), F.lit(no).alias("table_no"),
            F.lit("csv").alias("category"), "n_rows", F.lit(None).cast("string").alias("label"))
        for name, (f, t, no, _, _) in USER_TABLES.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_FILE = month_file()
_JOB = "concat('job', CAST(year(o_orderdate) AS STRING))"

# Findings built from the star schema; files are months, jobs are years.
ENTITIES = f"""
SELECT {_JOB} AS job_id, {_FILE} AS source_file, CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name,
  'PERSON' AS type, concat('buyer ', CAST(o_orderkey % 4 AS STRING)) AS mention,
  CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS confidence, o_orderkey * 10 AS ordinal
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL
SELECT {_JOB}, {_FILE}, s_name, 'ORG', CAST(NULL AS STRING), CAST(60 + l_orderkey % 40 AS DOUBLE) / 100,
  l_orderkey * 10 + l_linenumber
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey
UNION ALL
SELECT {_JOB}, {_FILE}, n_name, 'LOCATION', concat('in ', lower(n_name)), CAST(0.5 AS DOUBLE), o_orderkey * 10 + 9
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""
RELATIONS = f"""
SELECT {_JOB} AS job_id, {_FILE} AS source_file, c_name AS source_entity, s_name AS target_entity,
  CASE WHEN l_returnflag = 'R' THEN 'PAID' ELSE 'TRANSACTED_WITH' END AS relation_type,
  concat('order ', CAST(l_orderkey AS STRING), ' line ', CAST(l_linenumber AS STRING)) AS evidence,
  CAST(0.6 AS DOUBLE) AS confidence, l_orderkey * 10 + l_linenumber AS ordinal
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
  JOIN {{supplier}} ON l_suppkey = s_suppkey
UNION ALL
SELECT {_JOB}, {_FILE}, c_name, n_name, 'LOCATED_IN', concat('nation of order ', CAST(o_orderkey AS STRING)),
  CAST(0.9 AS DOUBLE), o_orderkey * 10
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""
PII = f"""
SELECT {_JOB} AS job_id, {_FILE} AS source_file, o_orderkey AS finding_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'IBAN' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'DOB' ELSE 'SALARY' END AS category,
  CASE o_orderkey % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'odd' ELSE 'low' END AS severity,
  CASE o_orderkey % 3 WHEN 0 THEN 'rules_checksum' WHEN 1 THEN 'rules_shape' ELSE 'llm' END AS detection_method,
  concat('*', CAST(o_orderkey AS STRING)) AS value_redacted, o_orderpriority AS location,
  CASE WHEN o_orderkey % 4 = 0 THEN c_name ELSE '' END AS subject_entity
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
"""
FACTS = f"""
SELECT {_JOB} AS job_id, {_FILE} AS source_file,
  CASE WHEN o_totalprice > 450000 THEN 'Anomaly: large order' ELSE 'Order total' END AS label,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END AS currency, o_orderkey AS ordinal
FROM {{orders}}
"""
# Month files plus a file per document, so that some files have no findings at all.
FILES = f"""
SELECT DISTINCT {_FILE} AS source_file, 'csv' AS category FROM {{orders}}
UNION ALL
SELECT concat(source, '/doc_', CAST(doc_id AS STRING), '.txt'), CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'pdf' END
FROM {{documents}}
"""
