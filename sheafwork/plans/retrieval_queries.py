"""Question, search and guarded-SQL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions.text import BUSINESS_KEYWORDS
from sheafwork.operators import retrieval as V
from sheafwork.plans import graph_queries as GQ
from sheafwork.plans import inputs as I
from sheafwork.plans.registry import query

# Questions made from conversations: every turn, with a phrase by turn and conversation.
ASKED = """
SELECT conv_id * 1000 + turn AS question_id, concat(CASE (conv_id + turn) % 8
    WHEN 0 THEN 'How many rows mention ' WHEN 1 THEN 'What is in the Emails and the json file about '
    WHEN 2 THEN 'Check the spreadsheet and database for ' WHEN 3 THEN 'Summarize the payroll contract: '
    WHEN 4 THEN 'Show the screenshot of the source code with ' ELSE '' END, text) AS text FROM {conversations}
"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def categories_sql() -> str:
    cats = {c: _any(p) for c, p in V.FORMAT_PHRASES.items()}
    for c in V.BUSINESS_CATEGORIES:
        cats[c] = f"({cats[c]} OR {_any(BUSINESS_KEYWORDS)})" if c in cats else _any(BUSINESS_KEYWORDS)
    cases = ", ".join(f"CASE WHEN {cats[c]} THEN '{c}' END" for c in sorted(cats))
    return f"nullif(array_to_string(list_filter([{cases}], lambda c: c IS NOT NULL), ','), '')"


_QUANT = V.QUANTITATIVE.replace("{", "{{").replace("}", "}}")


@query("V3", f"SELECT question_id, {categories_sql()} AS categories FROM ({ASKED})")
def infer_categories(t):
    return t.sql(ASKED).select("question_id", F.array_join(V.infer_categories(F.col("text")), ",").alias("categories"))


@query("V4", f"SELECT question_id, regexp_matches(text, '{_QUANT}') AS quantitative FROM ({ASKED})")
def looks_quantitative(t):
    return t.sql(ASKED).select("question_id", V.looks_quantitative(F.col("text")).alias("quantitative"))


# Candidate statements, two attempts or three per order.
_REPLIES = """
SELECT o_orderkey AS question_id, a AS attempt, CASE (o_orderkey * 3 + a) % 7
  WHEN 0 THEN concat('```sql', chr(10), 'SELECT count(*) FROM orders WHERE o_custkey = ', CAST(o_custkey AS STRING), chr(10), '```')
  WHEN 1 THEN concat('SELECT 1; DROP TABLE t', CAST(o_custkey AS STRING)) WHEN 2 THEN '  with x as (select 1) select * from x ; '
  WHEN 3 THEN concat('SELECT ''NOT_ANSWERABLE'' AS error -- ', o_orderpriority) WHEN 4 THEN 'select replace(o_orderstatus, ''O'', ''x'') from orders'
  WHEN 5 THEN concat('The answer is ', o_orderstatus) ELSE 'SELECT updated_at, max(o_totalprice) FROM orders' END AS reply
FROM {orders}, (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 3) tries
"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_EXTRACT = _TRIM.format(f"CASE WHEN starts_with({_TRIM.format('reply')}, '```') THEN regexp_replace(regexp_replace({_TRIM.format('reply')}, "
                        r"'(?i)^```(sql)?\s*', ''), '\s*```$', '') ELSE reply END")
_BARE = r"regexp_replace(sql, '^\s+|[\s;]+$', '', 'g')"
_SAFE = (f"({_BARE} <> '' AND NOT contains({_BARE}, ';') AND regexp_matches({_BARE}, '(?i)^(select|with)\\b') "
         f"AND NOT regexp_matches({_BARE}, '{V.FORBIDDEN}'))")


@query("V5, V6", f"SELECT question_id, attempt, sql, contains(upper(sql), 'NOT_ANSWERABLE') AS refused, {_SAFE} AS safe FROM (SELECT *, {_EXTRACT} AS sql FROM ({_REPLIES}))")
def guard_statements(t):
    rows = t.sql(_REPLIES).withColumn("sql", V.extract_sql(F.col("reply")))
    return rows.select("question_id", "attempt", "sql", V.not_answerable(F.col("sql")).alias("refused"),
                       V.is_safe_select(F.col("sql")).alias("safe"))


@query("V9", f"""
WITH c AS (SELECT *, {_EXTRACT} AS sql FROM ({_REPLIES})), l AS (SELECT c.* FROM c JOIN (SELECT question_id, max(attempt) AS attempt FROM c GROUP BY 1) USING (question_id, attempt))
SELECT question_id, attempt, sql, CASE WHEN contains(upper(sql), 'NOT_ANSWERABLE') THEN 'not answerable' WHEN {_SAFE} THEN 'accepted' ELSE 'rejected' END AS verdict,
  CASE WHEN contains(upper(sql), 'NOT_ANSWERABLE') THEN 'schema cannot answer' WHEN {_SAFE} THEN NULL
    WHEN regexp_matches(sql, '{V.FORBIDDEN}') THEN 'forbidden word' ELSE 'not a single read-only select' END AS reason FROM l
""")
def triage_sql(t):
    return V.triage_sql(t.sql(_REPLIES))


@query("V7", f"""
WITH s AS (SELECT o.status, p.segment, count(*) AS n, sum(count(*)) OVER (PARTITION BY o.status) AS of_status
  FROM ({I.ORDERS_TABLE}) o JOIN ({I.CUSTOMER_TABLE}) p ON o.CustomerID = p.cust_id GROUP BY o.status, p.segment)
SELECT coalesce(CAST(status AS STRING), '') AS status, coalesce(CAST(segment AS STRING), '') AS segment, CAST(n AS STRING) AS n,
  CAST(of_status AS STRING) AS of_status, false AS truncated FROM s
""")
def ask_sql(t):
    tables = {"orders": t.sql(I.ORDERS_TABLE), "customers": t.sql(I.CUSTOMER_TABLE)}
    rows, error = V.answer_sql(t.spark, tables, """
        WITH s AS (SELECT o.status, c.segment, count(*) AS n, sum(count(*)) OVER (PARTITION BY o.status) AS of_status
                   FROM orders o JOIN customers c ON o.CustomerID = c.cust_id GROUP BY o.status, c.segment)
        SELECT * FROM s ORDER BY status, segment;""", seconds=600)
    if error:
        raise RuntimeError(error)
    return rows


_MANIFEST = """
SELECT row_number() OVER (ORDER BY c_custkey) AS ordinal, concat('t_', CAST(c_custkey AS STRING)) AS table_name,
  concat(lower(c_mktsegment), '.csv') AS source_file, c_nationkey AS row_count FROM {customer}
"""


@query("V8", f"""
WITH m AS (SELECT c_custkey AS ordinal, concat('t_', c_custkey) AS table_name, concat(lower(c_mktsegment), '.csv') AS source_file, c_nationkey AS row_count FROM {{customer}})
SELECT concat((SELECT string_agg(concat('Table "', table_name, '" (from ', source_file, ', ', row_count, ' rows): id (INTEGER), name (TEXT)'), chr(10) ORDER BY ordinal)
  FROM m)) AS schema_text
""")
def schema_prompt(t):
    pair = lambda n, k: F.struct(F.lit(n).alias("name"), F.lit(k).alias("type"))
    manifest = t.customer.select(
        F.col("c_custkey").alias("ordinal"), F.concat(F.lit("t_"), "c_custkey").alias("table_name"),
        F.concat(F.lower("c_mktsegment"), F.lit(".csv")).alias("source_file"), F.col("c_nationkey").alias("row_count"),
        F.array(pair("id", "INTEGER"), pair("name", "TEXT")).alias("columns"))
    return V.schema_prompt(manifest)


# Vectors: label n stands for a category; the mean vector of each label is a question.
_CATS = "CASE label % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'web' END"
_CENTRES = """SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
  FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}) GROUP BY label, i) GROUP BY label"""


def vectors(t):
    cat = F.expr(_CATS)
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), cat.alias("category"), "embedding", "label")


def centres(t):
    per = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return per.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))


@query("V1", f"""
WITH q AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m
  FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {{embeddings}}) GROUP BY i))
SELECT vec_id AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM {{embeddings}}, q ORDER BY score DESC, vec_id LIMIT 8
""")
def vector_search(t):
    mean = t.embeddings.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vector = [r.m for r in mean.orderBy("i").collect()]
    found = V.vector_search(vectors(t), vector)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query("V1, V2", f"""
WITH q AS (SELECT label, v, CASE label % 3 WHEN 0 THEN ['pdf', 'web'] WHEN 1 THEN ['email'] END AS cats FROM ({_CENTRES})),
s AS (SELECT q.label AS question_id, vec_id AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM {{embeddings}} e, q
  WHERE cats IS NULL OR NOT list_has_any(cats, ['pdf', 'csv', 'json', 'web']) OR list_contains(cats, CASE e.label % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'web' END))
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8
""")
def vector_search_many(t):
    wanted = F.when(F.col("label") % 3 == 0, F.array(F.lit("pdf"), F.lit("web"))).when(F.col("label") % 3 == 1, F.array(F.lit("email")))
    asked = centres(t).select(F.col("label").alias("question_id"), "vector", wanted.alias("categories"))
    return V.vector_search_many(vectors(t), asked).withColumn("score", F.round("score", 6))


@query("V2", f"""
WITH q AS (SELECT v FROM ({_CENTRES}) WHERE label = 3)
SELECT vec_id AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM {{embeddings}}, q ORDER BY score DESC, vec_id LIMIT 8
""")
def category_filter_dropped(t):
    vector = centres(t).filter("label = 3").first().vector
    found = V.vector_search(vectors(t), vector, categories=["office"])
    return found.select("chunk_id", F.round("score", 6).alias("score"))


_HITS = """
SELECT conv_id AS question_id, CAST(turn + 1 AS INT) AS rank, concat('chat/', CAST(conv_id AS STRING), '.txt') AS source_file,
  CASE WHEN turn % 2 = 0 THEN CAST(turn AS INT) END AS page, CAST(90 - turn AS DOUBLE) / 100 AS score, text FROM {conversations}
"""


@query("V10", f"""
SELECT question_id, concat('Passages found:', chr(10), chr(10), string_agg(concat('[', source_file, CASE WHEN page IS NULL THEN '' ELSE concat(' p.', page) END,
    '] (score=', format('{{{{:.2f}}}}', score), ')', chr(10), text), chr(10) || chr(10) ORDER BY rank)) AS context,
  string_agg(concat(source_file, ': ', text), chr(10) ORDER BY rank) AS citations
FROM ({_HITS}) GROUP BY question_id
""")
def build_context(t):
    return V.build_context(t.sql(_HITS))


@query("V10", """
SELECT conv_id, turn, role, age, regexp_matches(lower(text), 'don''t know|not contain|no information|cannot find') AS uncertain FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM {conversations}) WHERE age <= 6
""")
def history_window(t):
    out = V.history_window(t.conversations)
    return out.select("conv_id", "turn", "role", "age", V.is_uncertain(F.col("text")).alias("uncertain"))


# Each question borrows the vector whose id is its number modulo the number of vectors.
_ASKED_VEC = f"""
SELECT a.question_id, a.text, CAST(e.embedding AS DOUBLE[]) AS v FROM ({ASKED}) a
JOIN {{embeddings}} e ON e.vec_id = a.question_id % (SELECT count(*) FROM {{embeddings}})
"""


_CHUNK_INFO = """
SELECT 'corpus' AS job_id, vec_id AS chunk_id, concat('doc_', CAST(vec_id AS STRING), '.txt') AS source_file,
  CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 7 AS INT) END AS page, coalesce(text, '') AS text FROM {embeddings} LEFT JOIN {documents} ON doc_id = vec_id
"""


@query("V10, V11", f"""
WITH q AS (SELECT *, {categories_sql()} AS categories, CASE WHEN regexp_matches(text, '{_QUANT}') THEN 'structured' ELSE 'retrieval' END AS route FROM ({_ASKED_VEC})),
c AS (SELECT *, list_filter(coalesce(string_split(categories, ','), []), lambda x: list_contains(['csv', 'json', 'pdf', 'web'], x)) AS eff FROM q WHERE route = 'retrieval'),
s AS (SELECT question_id, vec_id AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM c, {{embeddings}}
  WHERE len(eff) = 0 OR list_contains(eff, {_CATS})),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s) WHERE rank <= 8),
mentions AS ({GQ.MENTIONS}), edges AS ({GQ.WORD_EDGES}),
dom AS ({GQ.dominant_sql(GQ.TEXT_NODES, "SELECT * FROM edges", "SELECT * FROM mentions")}),
n AS (SELECT DISTINCT c.question_id, t.name AS entity, t.type FROM c JOIN ({GQ.TEXT_NODES}) t ON contains(lower(c.text), lower(t.name))),
seeds AS (SELECT DISTINCT question_id, name AS entity, type, 0 AS src FROM h JOIN mentions USING (chunk_id) UNION ALL SELECT *, 1 FROM n
  UNION ALL SELECT question_id, name, 'PERSON', 1 FROM c, dom WHERE question_id NOT IN (SELECT question_id FROM n)),
r AS (SELECT source AS entity, source_type AS type, concat_ws(' ', source, type, target) AS told FROM edges
  UNION SELECT target, target_type, concat_ws(' ', source, type, target) FROM edges),
e AS (SELECT question_id, entity, arg_min(seeds.type, concat(src, seeds.type)) AS type, count(DISTINCT told) AS n,
  coalesce(string_agg(DISTINCT told, '; ' ORDER BY told), 'nothing recorded') AS told FROM seeds LEFT JOIN r USING (entity, type) GROUP BY ALL),
f AS (SELECT question_id, count(*) AS entities, sum(n) AS facts, string_agg(concat(entity, ' (', type, '): ', told), chr(10) || chr(10)
  ORDER BY concat(entity, ' (', type, '): ', told)) AS told FROM e GROUP BY 1),
p AS (SELECT question_id, count(*) AS hits, max(chunk_id) FILTER (WHERE rank = 1) AS best_chunk,
  string_agg(concat('[', source_file, CASE WHEN page IS NULL THEN '' ELSE concat(' p.', page) END, '] (score=', format('{{{{:.2f}}}}', round(score, 12)), ')', chr(10), text),
    chr(10) || chr(10) ORDER BY rank) AS passages, string_agg(concat(source_file, ': ', text), chr(10) ORDER BY rank) AS citations
  FROM h JOIN ({_CHUNK_INFO}) USING (chunk_id) GROUP BY 1)
SELECT question_id, route, categories, coalesce(hits, 0) AS hits, best_chunk, coalesce(entities, 0) AS entities, coalesce(facts, 0) AS facts,
  CASE WHEN route = 'structured' THEN 'sql' WHEN coalesce(hits, 0) = 0 AND coalesce(entities, 0) = 0 THEN 'nothing indexed' ELSE 'context' END AS status,
  CASE WHEN passages IS NOT NULL OR told IS NOT NULL THEN sha256(concat_ws(chr(10) || chr(10), 'Passages found:' || chr(10) || chr(10) || passages,
    chr(10) || 'What the graph says:' || chr(10) || chr(10) || told)) END AS context_sha256,
  length(citations) AS citation_chars
FROM q LEFT JOIN p USING (question_id) LEFT JOIN f USING (question_id)
""")
def retrieve(t):
    n = t.embeddings.agg(F.count("*")).scalar()
    job = F.lit("corpus").alias("job_id")
    asked = t.sql(ASKED).withColumn("vec_id", F.col("question_id") % n)
    asked = asked.join(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id").select("*", job)
    chunks = vectors(t).drop("label").join(t.sql(_CHUNK_INFO), "chunk_id")
    found = V.retrieve(asked, chunks, GQ.text_nodes(t), GQ.word_edges(t), GQ.text_mentions(t), has_tables=True)
    return found.select(*[c for c in found.columns if c not in ("context", "citations")],
                        F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"), F.length("citations").alias("citation_chars"))
