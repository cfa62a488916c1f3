"""Mapping and schema-catalog queries over the dirty string tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions.text import ALIASES, standardize_column
from sheafwork.operators import catalog as C
from sheafwork.operators import mapping as M
from sheafwork.operators import quality as Q
from sheafwork.operators import tabular as Y
from sheafwork.plans import inputs as I
from sheafwork.functions import cells as cells_rules
from sheafwork.plans.quality_queries import NUMBER, QUALITY, _in, guess_sql, percent
from sheafwork.plans.registry import query
from sheafwork.session import shared_checkpoint

CELLS, TABLES = I.cells_sql(), I.tables_sql()
_ALIAS = "MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in ALIASES.items()) + "}}"


def std_sql(name: str) -> str:
    """Standard name of a header expression."""
    split = (f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), "
             f"'([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')")
    mapped = f"list_transform(CASE WHEN len({split}) = 0 THEN ['field'] ELSE {split} END, lambda x: coalesce({_ALIAS}[x], x))"
    return f"array_to_string(list_filter({mapped}, lambda x, i: i = 1 OR ({mapped})[i - 1] <> x), '_')"


def entity_sql(cols: str) -> str:
    """Archetype of a list of standard names."""
    scores = ", ".join(
        "{{'n': '" + name + "', 's': " + " + ".join(f"len(list_filter({cols}, lambda x: contains(x, '{w}')))" for w in words)
        + f", 'r': {i}" + "}}" for i, (name, words) in enumerate(M.ARCHETYPES.items()))
    return (f"(SELECT CASE WHEN s.s >= 2 THEN s.n END FROM (SELECT unnest([{scores}]) AS s) ORDER BY s.s DESC, s.r LIMIT 1)")


_HEADERS = f"""SELECT DISTINCT source_file, table_id, table_no, col_idx, "column", {std_sql('"column"')} AS target FROM
  (SELECT DISTINCT source_file, table_id, table_no, col_idx, "column" FROM ({CELLS}))"""
_RAW_NAMES = """
SELECT DISTINCT raw FROM (
  SELECT concat(o_orderstatus, 'Cust', p, 'ID_', lower(o_orderpriority), ' Total-Amt') AS raw FROM
    (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Tel' WHEN 1 THEN 'customer ' WHEN 2 THEN '_qtyQuantity' ELSE '2ndAddr' END AS p FROM {orders})
  UNION ALL SELECT c_mktsegment FROM {customer} UNION ALL SELECT concat('--', p_brand, '##') FROM {part}
  UNION ALL SELECT repeat('-', CAST(p_size AS INT)) FROM {part})
"""


@query("M1", f"SELECT raw, {std_sql('raw')} AS standard FROM ({_RAW_NAMES})")
def standardize_columns(t):
    return t.sql(_RAW_NAMES).select("raw", standardize_column(F.col("raw")).alias("standard"))


@query("M2, M3", f"""
SELECT table_no, {entity_sql('c')} AS entity FROM (SELECT table_no, list(DISTINCT target) AS c FROM ({_HEADERS}) GROUP BY table_no)
""")
def classify_tables(t):
    return M.entity_names(M.headers(I.cells(t)))


_SHORT = ("(SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ') FROM (SELECT unnest(string_split("
          "replace(regexp_extract({0}, '([^/]*)[.][^./]*$', 1), '_', ' '), ' ')) AS w))")
JOINS = f"""
WITH h AS ({_HEADERS}), v AS (SELECT DISTINCT table_no, col_idx, lower(trim(value)) AS v FROM ({CELLS}) WHERE value <> ''),
n AS (SELECT table_no, col_idx, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT ha.target, ha.table_no AS ta, ha.col_idx AS ca, hb.table_no AS tb, hb.col_idx AS cb, ha.source_file AS fa, hb.source_file AS fb,
    ha."column" AS na, hb."column" AS nb FROM h ha JOIN h hb ON ha.target = hb.target AND ha.source_file <> hb.source_file
    AND (ha.table_no, ha.col_idx) < (hb.table_no, hb.col_idx)),
s AS (SELECT p.*, (SELECT count(*) FROM v x JOIN v y ON x.v = y.v WHERE x.table_no = ta AND x.col_idx = ca AND y.table_no = tb AND y.col_idx = cb) AS shared FROM p),
k AS (SELECT s.*, a.n AS da, b.n AS db, ra.n_rows AS ra, rb.n_rows AS rb, f.seen FROM s JOIN n a ON a.table_no = ta AND a.col_idx = ca
  JOIN n b ON b.table_no = tb AND b.col_idx = cb JOIN ({TABLES}) ra ON ra.table_no = ta JOIN ({TABLES}) rb ON rb.table_no = tb
  JOIN (SELECT target, min(table_no * 1000 + col_idx) AS seen FROM h GROUP BY target) f ON f.target = s.target
  WHERE shared >= 2 AND shared * 20 >= a.n + b.n - shared),
o AS (SELECT *, row_number() OVER (PARTITION BY ta, tb ORDER BY seen, ca, cb) AS rn FROM k)
SELECT target, shared, CASE WHEN ra >= rb THEN fa ELSE fb END AS child_file, CASE WHEN ra >= rb THEN na ELSE nb END AS child_column,
  CASE WHEN ra >= rb THEN da ELSE db END AS child_distinct, CASE WHEN ra >= rb THEN fb ELSE fa END AS parent_file,
  CASE WHEN ra >= rb THEN nb ELSE na END AS parent_column, CASE WHEN ra >= rb THEN db ELSE da END AS parent_distinct,
  CASE WHEN ra >= rb THEN ta ELSE tb END AS child_no, CASE WHEN ra >= rb THEN tb ELSE ta END AS parent_no
FROM o WHERE rn = 1
"""


@query("M4, M5", f"SELECT target, shared, child_file, child_column, child_distinct, parent_file, parent_column, parent_distinct FROM ({JOINS})")
def find_joins(t):
    found = M.find_joins(I.cells(t), I.user_tables(t))
    return found.select("target", "shared", "child_file", "child_column", "child_distinct",
                        "parent_file", "parent_column", "parent_distinct")


_CHILD, _PARENT = _SHORT.format("child_file"), _SHORT.format("parent_file")
_QUALITY_TEXT = f"""concat(shared, ' of ', child_distinct, ' matched (', {percent('shared', 'child_distinct')}, '%)',
  CASE WHEN (child_distinct - shared) * 20 >= child_distinct THEN
    concat('; ', child_distinct - shared, ' ', {_CHILD}, ' rows point to no ', {_PARENT}, ' key') ELSE '' END,
  CASE WHEN parent_distinct > shared THEN
    concat('; ', parent_distinct - shared, ' ', {_PARENT}, ' rows without any ', {_CHILD}) ELSE '' END)"""
_BASE = "regexp_extract({0}, '([^/]*)$', 1)"
_LOGIC = (f"concat('FROM ', {_BASE.format('child_file')}, ' LEFT JOIN ', {_BASE.format('parent_file')}, ' ON ', {_BASE.format('child_file')}, "
          f"'.', child_column, ' = ', {_BASE.format('parent_file')}, '.', parent_column)")


@query("M6", f"""
SELECT target, child_file, parent_file, child_distinct - shared AS orphans, parent_distinct - shared AS idle_parents,
  {_QUALITY_TEXT} AS join_quality, {_LOGIC} AS join_logic FROM ({JOINS})
""")
def join_quality(t):
    found = M.join_quality(M.find_joins(I.cells(t), I.user_tables(t)))
    return found.select("target", "child_file", "parent_file", "orphans", "idle_parents", "join_quality", "join_logic")


@query("M7", f"""
SELECT c.OrderID, c.CustomerID, p.cust_id AS parent_cust_id, p.segment AS parent_segment FROM ({I.ORDERS_TABLE}) c
LEFT JOIN ({I.CUSTOMER_TABLE}) p ON lower(trim(c.CustomerID)) = lower(trim(p.cust_id))
""")
def build_joined(t):
    joined = M.build_joined(t.sql(I.ORDERS_TABLE), t.sql(I.CUSTOMER_TABLE), "CustomerID", "cust_id")
    return joined.select("OrderID", "CustomerID", "parent_cust_id", "parent_segment")


def _slug(name: str) -> str:
    return f"concat(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '.csv')"


_ENTITY = f"SELECT table_no, {entity_sql('c')} AS entity FROM (SELECT table_no, list(DISTINCT target) AS c FROM ({_HEADERS}) GROUP BY table_no)"
PROPOSALS = f"""
WITH j AS ({JOINS}), e AS ({_ENTITY}),
l AS (SELECT coalesce(entity, concat({_CHILD}, ' with ', {_PARENT})) AS name,
  concat('Adds to each ', {_CHILD}, ' row the columns of ', {_PARENT}, ' through ', target, ', so ', lower({_CHILD}),
    ' by ', lower({_PARENT}), ' needs no join by hand') AS purpose,
  concat('A row for each ', {_CHILD}, ' record.') AS grain, concat(least(child_file, parent_file), ', ', greatest(child_file, parent_file)) AS source_files,
  {_LOGIC} AS join_logic, {_QUALITY_TEXT} AS join_quality FROM j LEFT JOIN e ON child_no = e.table_no),
s AS (SELECT coalesce(entity, {_SHORT.format('source_file')}) AS name,
  'A table by itself: no other file shares a key with it' AS purpose,
  concat('A row for each row of ', source_file, '::', table_id, '.') AS grain, source_file AS source_files,
  CAST(NULL AS STRING) AS join_logic, CAST(NULL AS STRING) AS join_quality
  FROM ({TABLES}) x LEFT JOIN e USING (table_no) WHERE table_no NOT IN (SELECT child_no FROM j UNION SELECT parent_no FROM j))
SELECT *, {_slug('name')} AS target_file FROM (SELECT * FROM l UNION ALL SELECT * FROM s)
"""


@query("M8, M9", PROPOSALS)
def bi_proposals(t):
    return M.bi_proposals(I.cells(t), I.user_tables(t)).withColumn("source_files", F.array_join("source_files", ", "))


@query("M11", f"SELECT join_logic IS NOT NULL AS linked, name, source_files, target_file FROM ({PROPOSALS})")
def proposal_split(t):
    found = M.bi_proposals(I.cells(t), I.user_tables(t))
    both = M.linked(found).withColumn("linked", F.lit(True)).unionByName(
        M.standalone(found).withColumn("linked", F.lit(False)))
    return both.select("linked", "name", F.array_join("source_files", ", ").alias("source_files"), "target_file")


_COLUMNS = f"""
SELECT h.source_file, h.table_id, h.col_idx, h."column", h.target AS target_column, {guess_sql('h."column"', 'n', 'num', 'word')} AS data_type_guess,
  array_to_string(s[1:5], ' | ') AS sample_values, CASE WHEN len(q.issues) > 0 THEN array_to_string(q.issues, '; ') END AS comments
FROM ({_HEADERS}) h JOIN (SELECT table_no, col_idx, coalesce(list(value ORDER BY row_id) FILTER (WHERE trim(value) <> ''), []) AS s, count(*) FILTER (WHERE trim(value) <> '') AS n,
    count(*) FILTER (WHERE trim(value) <> '' AND regexp_matches(replace(trim(value), ',', ''), '{NUMBER}')) AS num,
    count(*) FILTER (WHERE lower(trim(value)) IN {_in(cells_rules.BOOLEAN_WORDS)}) AS word
  FROM ({CELLS}) GROUP BY ALL) c USING (table_no, col_idx) JOIN ({QUALITY}) q USING (source_file, table_id, col_idx)
"""


@query("M10", _COLUMNS)
def proposal_columns(t):
    cells = I.cells(t)
    cols = M.proposal_columns(cells, Q.column_quality(Q.column_stats(cells)))
    return cols.withColumn("sample_values", F.array_join("sample_values", " | "))


# One table per order month and status: four header spellings, three shapes, two amount types.
_REGISTRY = """
SELECT concat('orders_', CAST(y AS STRING), '_', CAST(m AS STRING), '_', lower(s)) AS table_name,
  concat('erp/', CAST(y AS STRING), '/', s, '.csv') AS source_file, n AS row_count,
  y * 1000 + m * 10 + CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS ordinal,
  CASE m % 4 WHEN 0 THEN 'OrderID' WHEN 1 THEN 'order_id' WHEN 2 THEN 'Order Identifier' ELSE 'order-pk' END AS c1,
  CASE WHEN m % 2 = 0 THEN 'Amt' ELSE 'total' END AS c2,
  CASE s WHEN 'F' THEN 'cust' WHEN 'O' THEN 'site_code' ELSE 'note' END AS c3,
  CASE WHEN y % 2 = 0 THEN 'INTEGER' ELSE 'REAL' END AS t2, CASE WHEN m = 7 THEN 'TEXT' ELSE 'INTEGER' END AS t1
FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderstatus AS s, count(*) AS n FROM {orders} GROUP BY 1, 2, 3)
"""
_SIGNED = f"""
SELECT *, array_to_string(list_sort([{std_sql('c1')}, {std_sql('c2')}, {std_sql('c3')}]), ',') AS signature FROM ({_REGISTRY})
"""


def _registry(t):
    pair = lambda n, k: F.struct(n.alias("name"), k.alias("type"))
    cols = F.array(pair(F.col("c1"), F.col("t1")), pair(F.col("c2"), F.col("t2")), pair(F.col("c3"), F.lit("TEXT")))
    return t.sql(_REGISTRY).select("table_name", "source_file", "row_count", "ordinal", cols.alias("columns"))


@query("C1, C4", f"""
WITH g AS (SELECT signature, count(*) AS members, count(DISTINCT source_file) AS member_files, CAST(sum(row_count) AS BIGINT) AS row_count,
  arg_min(table_name, ordinal) AS f FROM ({_SIGNED}) GROUP BY signature),
e AS (SELECT *, upper({entity_sql("string_split(signature, ',')")}) AS entity FROM g)
SELECT signature, CASE WHEN entity IS NOT NULL THEN entity || CASE WHEN members > 1 THEN '_UNIONED' ELSE '' END
  WHEN members > 1 THEN 'COMBINED_' || upper(f) ELSE upper(f) END AS group_name, members > 1 AS combined, members, member_files, row_count FROM e
""")
def schema_groups(t):
    return C.schema_groups(_registry(t))


@query("C1", f"SELECT signature, ordinal, table_name, source_file, row_count FROM ({_SIGNED})")
def schema_members(t):
    return C.schema_members(_registry(t))


@query("C2", f"""
WITH c AS (SELECT signature, ordinal, i, CASE i WHEN 0 THEN {std_sql('c1')} WHEN 1 THEN {std_sql('c2')} ELSE {std_sql('c3')} END AS col,
  CASE CASE i WHEN 0 THEN t1 WHEN 1 THEN t2 ELSE 'TEXT' END WHEN 'INTEGER' THEN 0 WHEN 'REAL' THEN 1 ELSE 2 END AS r
  FROM ({_SIGNED}), (SELECT unnest([0, 1, 2]) AS i))
SELECT signature, upper(col) AS column_name, CASE max(r) WHEN 0 THEN 'NUMBER(38)' WHEN 1 THEN 'NUMBER(18,4)' ELSE 'VARCHAR2(255)' END AS rendered_type,
  min(ordinal) AS seen_table, arg_min(i, ordinal) AS seen_position FROM c GROUP BY signature, col
""")
def group_columns(t):
    return C.group_columns(_registry(t))


_TWO_SHAPES = """
SELECT CASE WHEN o_orderkey % 40 = 7 THEN 'lost' ELSE CAST(o_orderkey AS STRING) END AS order_id, o_totalprice AS amount,
  CASE WHEN o_custkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS customer, o_orderstatus AS s FROM {orders}
"""


@query("C3", f"""
SELECT 'row' AS what, TRY_CAST(order_id AS BIGINT) AS order_id, amount, TRY_CAST(customer AS BIGINT) AS customer, NULL AS value, 1 AS n FROM ({_TWO_SHAPES})
UNION ALL SELECT 'reject', NULL, NULL, NULL, 'lost', count(*) FROM ({_TWO_SHAPES}) WHERE order_id = 'lost'
""")
def union_group(t):
    rows = t.sql(_TWO_SHAPES)
    even = rows.where("s <> 'F'").select(F.col("order_id").alias("OrderID"), F.col("amount").alias("Amt"), F.col("customer").alias("cust"))
    odd = rows.where("s = 'F'").select(F.col("customer").alias("client"), F.col("order_id").alias("order_pk"), F.col("amount").cast("string").alias("total"))
    union, lost = C.union_group([even, odd])
    return union.select(F.lit("row").alias("what"), "*", F.lit(None).cast("string").alias("value"), F.lit(1).cast("bigint").alias("n")).unionByName(
        lost.select(F.lit("reject").alias("what"), "value", "n"), allowMissingColumns=True)


@query("S4", """
SELECT "column", dtype, rows, nulls, distinct_values, col_idx FROM (
  SELECT 0 AS col_idx, 'path' AS "column", 'string' AS dtype, count(*) AS rows, count(*) - count(path) AS nulls, count(DISTINCT path) AS distinct_values FROM (%(l)s)
  UNION ALL SELECT 1, 'size_bytes', 'bigint', count(*), count(*) - count(size_bytes), count(DISTINCT size_bytes) FROM (%(l)s)
  UNION ALL SELECT 2, 'ordinal', 'bigint', count(*), count(*) - count(ordinal), count(DISTINCT ordinal) FROM (%(l)s))
""" % {"l": I.LISTING})
def profile_columns(t):
    from sheafwork.sources.files import profile_columns as profile

    return profile(t.sql(I.LISTING))


@query("K3", f"""
WITH c AS (SELECT source_file, "column" AS source_column, target_column, split_part(sample_values, ' | ', 1) AS sample_value, comments FROM ({_COLUMNS}))
SELECT p.name AS proposed_target_table_name, p.target_file, c.source_column, c.source_file, c.target_column,
  coalesce(c.comments, '') AS comments, coalesce(c.sample_value, '') AS sample_value,
  coalesce(p.join_logic, concat('Taken from ', {_BASE.format('c.source_file')}, ', columns renamed')) AS rule
FROM ({PROPOSALS}) p JOIN c ON list_contains(string_split(p.source_files, ', '), c.source_file)
""")
def mapping_rows(t):
    from sheafwork.sinks.exports import mapping_rows as rows

    cells = I.cells(t)
    names = shared_checkpoint(M.headers(cells))
    cols = M.proposal_columns(cells, Q.column_quality(Q.column_stats(cells)), columns=names)
    return rows(M.bi_proposals(cells, I.user_tables(t), columns=names), cols)
