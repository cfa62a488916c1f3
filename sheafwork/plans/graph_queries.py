"""Model-response and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.operators import graph as G
from sheafwork.operators import responses as R
from sheafwork.plans import inputs as I
from sheafwork.plans.registry import query
from sheafwork.session import shared_table

# One NER response per order, some fenced, some broken; other agents per customer or order.
_NER = """
SELECT concat('orders/', CAST(o_orderkey % 500 AS STRING), '.txt') AS source_file, 'NER' AS agent, o_orderkey AS segment_no,
  CASE o_orderkey % 7
    WHEN 0 THEN concat('Sure: ```json', chr(10), body, chr(10), '```') WHEN 1 THEN substr(body, 1, 40)
    WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN concat(body, ' and ', body) WHEN 4 THEN concat(body, ' x') ELSE body END AS response
FROM (SELECT *, concat('{{"entities": [{{"name": "', CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END,
  '", "type": "PERSON", "mentions": ["m', CAST(o_orderkey % 9 AS STRING), '", "buyer"], "confidence": 0.', CAST(o_orderkey % 9 + 1 AS STRING),
  '}}, {{"name": "', c_mktsegment, '"}}, {{"type": "ORG"}}, {{"name": "x", "confidence": "high"}}, 7, "note", null, [1], {{"name": "y", "mentions": "z"}}, {{"name": "w", "mentions": null}}]}}') AS body
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey)
"""
_OTHERS = """
SELECT concat('orders/', CAST(o_orderkey % 500 AS STRING), '.txt') AS source_file, 'PII' AS agent, o_orderkey AS segment_no,
  concat('{{"findings": [{{"category": "EMAIL", "value_redacted": "j***", "severity": "medium", "location": "l',
    CAST(o_orderkey AS STRING), '", "subject_entity": " ', lower(c_name), ' "}}, {{"location": "here", "subject_entity": "Nobody"}}, 7, "note"]}}') AS response
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT concat('orders/', CAST(o_orderkey % 500 AS STRING), '.txt'), 'Financial', o_orderkey,
  concat('{{"facts": [{{"label": "Total", "amount": ', CAST(o_custkey AS STRING), ', "currency": "USD"}}, {{"amount": "12.5"}}, ',
    '{{"label": "bad", "amount": "n/a"}}, {{"label": "none", "amount": null, "period": "Q1"}}, [2]]}}')
FROM {orders}
UNION ALL
SELECT concat('orders/', CAST(o_orderkey % 600 AS STRING), '.txt'), 'Relation', o_orderkey,
  concat('{{"relations": [{{"source_entity": "', c_name, '", "target_entity": "', c_mktsegment, '", "confidence": 0.5}}, ',
    '{{"source_entity": "a", "relation_type": "OWNS"}}, {{"source_entity": "a", "target_entity": "b", "relation_type": "OWNS", "evidence": "e"}}]}}')
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
_ALL = f"SELECT * FROM ({_NER}) UNION ALL SELECT * FROM ({_OTHERS})"
_JSON = r"""
SELECT *, CASE WHEN json_valid(trim(response)) AND starts_with(trim(response), chr(123)) THEN trim(response)
  WHEN json_valid(regexp_extract(trim(response), '(?s)(\{{.*\}})', 1)) THEN regexp_extract(trim(response), '(?s)(\{{.*\}})', 1) END AS json
"""


def _items(agent: str, field: str) -> str:
    return f"""SELECT source_file, segment_no, CAST(i - 1 AS INT) AS item_no, x[i] AS x FROM (
  SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT source_file, segment_no, CAST(json_extract(json, '$.{field}') AS JSON[]) AS x
  FROM ({_JSON} FROM ({_ALL})) WHERE agent = '{agent}' AND json IS NOT NULL)) WHERE json_type(x[i]) = 'OBJECT'"""


def _str(name: str) -> str:
    return f"json_extract_string(x, '$.{name}')"


_ENT = f"""SELECT source_file, segment_no, item_no, {_str('name')} AS name, coalesce({_str('type')}, 'OTHER') AS type,
  coalesce(TRY_CAST(json_extract(x, '$.mentions') AS STRING[]), []) AS mentions,
  CASE WHEN {_str('confidence')} IS NULL THEN CAST(0.7 AS DOUBLE) ELSE TRY_CAST({_str('confidence')} AS DOUBLE) END AS confidence
FROM ({_items('NER', 'entities')}) WHERE {_str('name')} IS NOT NULL
  AND ({_str('confidence')} IS NULL OR TRY_CAST({_str('confidence')} AS DOUBLE) IS NOT NULL)
  AND coalesce(json_type(json_extract(x, '$.mentions')), 'NULL') IN ('ARRAY', 'NULL')"""


@query("X2", f"SELECT source_file, segment_no, json IS NOT NULL AS ok FROM ({_JSON} FROM ({_ALL})) WHERE agent = 'NER'")
def salvage_json(t):
    return R.salvage_json(t.sql(_NER)).select("source_file", "segment_no", "ok")


@query("X3", f"SELECT * EXCLUDE (mentions), array_to_string(mentions, ',') AS mentions FROM ({_ENT})")
def parse_entities(t):
    return R.parse_entities(t.sql(_NER)).withColumn("mentions", F.array_join("mentions", ","))


@query("X4", f"""
WITH p AS (SELECT source_file, lower(name) AS k, min(name) AS known FROM ({_ENT}) WHERE type = 'PERSON' GROUP BY ALL)
SELECT source_file, segment_no, item_no, coalesce({_str('category')}, 'OTHER_PII') AS category, coalesce({_str('value_redacted')}, '***') AS value_redacted,
  coalesce({_str('severity')}, 'low') AS severity, {_str('location')} AS location, known AS subject_entity, 'llm' AS detection_method
FROM ({_items('PII', 'findings')}) LEFT JOIN p USING (source_file)  WHERE p.k = lower(trim({_str('subject_entity')}))
UNION ALL
SELECT source_file, segment_no, item_no, coalesce({_str('category')}, 'OTHER_PII'), coalesce({_str('value_redacted')}, '***'),
  coalesce({_str('severity')}, 'low'), {_str('location')}, NULL, 'llm'
FROM ({_items('PII', 'findings')}) i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_file = i.source_file AND p.k = lower(trim({_str('subject_entity')})))
""")
def parse_pii(t):
    return R.parse_pii(t.sql(_OTHERS), R.parse_entities(t.sql(_NER)))


@query("X5", f"""
SELECT source_file, segment_no, item_no, coalesce({_str('label')}, 'fact without label') AS label, TRY_CAST({_str('amount')} AS DOUBLE) AS amount,
  {_str('currency')} AS currency, {_str('period')} AS period, {_str('context')} AS context FROM ({_items('Financial', 'facts')})
WHERE {_str('amount')} IS NULL OR TRY_CAST({_str('amount')} AS DOUBLE) IS NOT NULL
""")
def parse_financial(t):
    return R.parse_financial(t.sql(_OTHERS))


@query("X6", f"""
SELECT source_file, segment_no, item_no, {_str('source_entity')} AS source_entity, {_str('target_entity')} AS target_entity,
  coalesce({_str('relation_type')}, 'RELATED_TO') AS relation_type, {_str('evidence')} AS evidence,
  coalesce(CAST({_str('confidence')} AS DOUBLE), 0.6) AS confidence FROM ({_items('Relation', 'relations')})
WHERE {_str('source_entity')} IS NOT NULL AND {_str('target_entity')} IS NOT NULL AND source_file IN (SELECT source_file FROM ({_ENT}))
""")
def parse_relations(t):
    return R.parse_relations(t.sql(_OTHERS), R.parse_entities(t.sql(_NER)))


@query("X7", f"""
WITH e AS (SELECT *, lower(trim(name)) AS k, segment_no * 100 + item_no AS ordinal FROM ({_ENT}))
SELECT source_file, arg_min(name, ordinal) AS name, type, max(confidence) AS confidence,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(mentions)))), ','), '') AS mentions FROM e GROUP BY source_file, k, type
""")
def dedup_file_entities(t):
    rows = R.parse_entities(t.sql(_NER)).withColumn("ordinal", F.col("segment_no") * 100 + F.col("item_no"))
    merged = R.dedup_entities(rows, ["source_file"])
    return merged.select("source_file", "name", "type", "confidence", F.array_join("mentions", ",").alias("mentions"))


@query("X8", f"""
SELECT source_file, agent, failed, total, concat(agent, ': ', failed, ' of ', total,
  ' segments gave no usable response') AS warning
FROM (SELECT source_file, agent, count(*) FILTER (WHERE json IS NULL) AS failed, count(*) AS total FROM ({_JSON} FROM ({_ALL})) GROUP BY ALL)
WHERE failed > 0
""")
def segment_failures(t):
    return R.segment_failures(t.sql(_ALL))


@query("X9", f"""
WITH n AS (SELECT source_file, string_agg(DISTINCT name, ''', ''' ORDER BY name) AS names FROM ({_ENT}) WHERE type = 'PERSON' GROUP BY ALL)
SELECT source_file, segment_no, CASE WHEN names IS NULL THEN segment
  ELSE concat('Known entities: [''', names, ''']', chr(10), chr(10), 'Text:', chr(10), segment) END AS prompt
FROM (SELECT concat('orders/', CAST(doc_id AS STRING), '.txt') AS source_file, doc_id AS segment_no, text AS segment FROM {{documents}})
LEFT JOIN n USING (source_file)
""")
def prompt_inputs(t):
    segments = t.sql("SELECT concat('orders/', CAST(doc_id AS STRING), '.txt') AS source_file, doc_id AS segment_no, "
                     "text AS segment FROM {documents}")
    out = R.prompt_inputs(segments, R.parse_entities(t.sql(_NER)), person_only=True)
    return out.select("source_file", "segment_no", "prompt")


@query("X10", f"""
WITH f AS (SELECT DISTINCT concat('orders/', CAST(o_orderkey % 700 AS STRING), '.txt') AS source_file FROM {{orders}}),
e AS (SELECT source_file, agent FROM f, (SELECT unnest(['NER', 'PII', 'Financial', 'Relation']) AS agent)),
m AS (SELECT * FROM e WHERE (source_file, agent) NOT IN (SELECT (source_file, agent) FROM ({_ALL})))
SELECT source_file, string_agg(agent, ', ' ORDER BY agent) AS missing_agents,
  'Extraction skipped: no model response for ' || string_agg(agent, ', ' ORDER BY agent) AS warning FROM m GROUP BY source_file
""")
def missing_responses(t):
    files = t.sql("SELECT DISTINCT concat('orders/', CAST(o_orderkey % 700 AS STRING), '.txt') AS source_file FROM {orders}")
    agents = F.explode(F.array(*[F.lit(a) for a in ("NER", "PII", "Financial", "Relation")]))
    return R.missing_responses(files.withColumn("agent", agents), t.sql(_ALL))


@query("X1", r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM {documents}),
g AS (SELECT doc_id, CAST(i AS INT) AS segment_no, substr(s, CAST(i * 8000 + 1 AS BIGINT), 8000) AS t
  FROM (SELECT doc_id, s, unnest(range(0, CAST(ceil(length(s) / 8000.0) AS BIGINT))) AS i FROM d WHERE s <> ''))
SELECT doc_id, segment_no, 'NER' AS agent, CASE WHEN contains(t, '%%%') THEN NULL ELSE concat('{{"entities": [{{"name": "',
    replace(replace(array_to_string(regexp_extract_all(t, '\S+')[1:2], ' '), '"', ''), chr(92), ''), '"}}]}}') END AS response,
  CASE WHEN contains(t, '%%%') THEN 'ValueError: noise' END AS error FROM g
""")
def run_extractor(t):
    from sheafwork.operators.text import segment_text

    segments = segment_text(t.documents.select("doc_id", "text"))

    def first_words(text: str) -> str:
        if "%%%" in text:
            raise ValueError("noise")
        return '{"entities": [{"name": "%s"}]}' % " ".join(text.split()[:2]).replace('"', "").replace("\\", "")

    out = R.run_extractor(segments, "NER", first_words)
    return out.select("doc_id", "segment_no", "agent", "response", "error")


# ---------------------------------------------------------------- graph
NODES = f"""
SELECT job_id, name, type, max(confidence) AS confidence, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files
FROM ({I.ENTITIES}) GROUP BY job_id, name, type
"""
EDGES = f"""
WITH f AS (SELECT job_id, source_entity, target_entity, relation_type, min(ordinal) AS ordinal FROM ({I.RELATIONS}) GROUP BY ALL),
r AS (SELECT f.*, r.evidence, r.confidence, r.source_file, row_number() OVER (PARTITION BY f.job_id, f.source_entity, f.target_entity, f.relation_type
    ORDER BY r.evidence, r.confidence, r.source_file) AS k FROM f JOIN ({I.RELATIONS}) r USING (job_id, source_entity, target_entity, relation_type, ordinal))
SELECT r.job_id, source_entity AS source, s.type AS source_type, target_entity AS target, g.type AS target_type,
  relation_type AS type, evidence, r.confidence, r.source_file, ordinal FROM r
JOIN ({NODES}) s ON s.job_id = r.job_id AND s.name = source_entity JOIN ({NODES}) g ON g.job_id = r.job_id AND g.name = target_entity WHERE k = 1
"""


def nodes(t):
    return G.upsert_entities(None, t.sql(I.ENTITIES))


def edges(t, n=None):
    return G.upsert_relations(None, t.sql(I.RELATIONS), nodes(t) if n is None else n)


@query("G1", NODES)
def upsert_entities(t):
    return nodes(t).withColumn("source_files", F.array_join("source_files", ","))


@query("G2", EDGES)
def upsert_relations(t):
    return edges(t)


@query("G6", f"""SELECT 'node' AS kind, count(*) AS n, count(DISTINCT name) AS names FROM ({NODES})
UNION ALL SELECT 'edge', count(*), count(DISTINCT source) FROM ({EDGES})""")
def merge_batches(t):
    """Nodes and edges merged in two batches equal one merge over everything."""
    ent, rel = t.sql(I.ENTITIES), t.sql(I.RELATIONS)
    early = F.col("ordinal") % 20 < 10
    first = G.upsert_entities(None, ent.filter(early))
    every = shared_table(G.upsert_entities(first, ent.filter(~early)), "nodes")  # used three times, the edges twice
    known = shared_table(G.upsert_relations(None, rel.filter(early), every), "edges")
    both = G.upsert_relations(known, rel.filter(~early), every)
    return every.agg(F.lit("node").alias("kind"), F.count("*").alias("n"), F.count_distinct("name").alias("names")).unionByName(
        both.agg(F.lit("edge").alias("kind"), F.count("*").alias("n"), F.count_distinct("source").alias("names")))


_WRITES = f"""SELECT concat('p', CAST(finding_id % 900 AS STRING)) AS finding_id, finding_id AS ordinal, job_id, category, severity, subject_entity FROM ({I.PII})"""


@query("G3", f"""
SELECT finding_id, arg_max(job_id, ordinal) AS job_id, arg_max(category, ordinal) AS category, arg_max(severity, ordinal) AS severity,
  arg_max(subject_entity, ordinal) AS subject_entity FROM ({_WRITES}) GROUP BY finding_id
""")
def upsert_pii(t):
    return G.upsert_pii(None, t.sql(_WRITES))


@query("G3", f"""
SELECT DISTINCT w.job_id, subject_entity, w.finding_id FROM ({_WRITES}) w JOIN ({NODES}) n ON n.job_id = w.job_id AND n.name = w.subject_entity AND n.type = 'PERSON'
""")
def has_pii(t):
    return G.has_pii(t.sql(_WRITES), nodes(t))


_CHUNK_WRITES = """
SELECT concat('c', CAST(doc_id AS STRING)) AS chunk_id, doc_id AS ordinal, text, source AS job_id FROM {documents}
UNION ALL SELECT concat('c', CAST(doc_id - doc_id % 4 AS STRING)), doc_id + 1000000000, concat('second ', text), source FROM {documents}
"""


@query("G4", f"""SELECT chunk_id, max(ordinal) AS ordinal, arg_max(text, ordinal) AS text, arg_max(job_id, ordinal) AS job_id
FROM ({_CHUNK_WRITES}) GROUP BY chunk_id""")
def upsert_chunks(t):
    return G.upsert_chunks(None, t.sql(_CHUNK_WRITES))


# Names looked for in text: distinct long words of the benchmark passages.
NAMES_SQL = r"""
SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS name FROM {benchmark})
"""


def text_names(t):
    return t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("name")).distinct()


def text_nodes(t):
    kind = F.when(F.length("name") % 2 == 0, "PERSON").otherwise("ORG")
    return text_names(t).select(F.lit("corpus").alias("job_id"), "name", kind.alias("type"))


TEXT_NODES = f"SELECT 'corpus' AS job_id, name, CASE WHEN length(name) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS type FROM ({NAMES_SQL})"


def doc_chunks(t):
    return t.documents.select(F.lit("corpus").alias("job_id"), F.col("doc_id").alias("chunk_id"), "text")


MENTIONS = f"SELECT n.job_id, d.doc_id AS chunk_id, n.name, n.type FROM {{documents}} d JOIN ({TEXT_NODES}) n ON contains(d.text, n.name)"


def text_mentions(t):
    return G.mentions(doc_chunks(t), text_nodes(t))


@query("G5", MENTIONS)
def mentions(t):
    return text_mentions(t)


# Relations between neighbouring words of a passage, so that mentioned entities have facts.
_WORD_EDGES = r"""
SELECT 'corpus' AS job_id, w[i] AS source, w[i + 1] AS target, CASE WHEN (item_id + i) % 2 = 0 THEN 'OWNS' ELSE 'MOTHER_OF' END AS type
FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{{6,}}') AS w FROM {benchmark}))
"""
WORD_EDGES = f"""
SELECT DISTINCT e.job_id, source, CASE WHEN length(source) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS source_type, target,
  CASE WHEN length(target) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS target_type, type FROM ({_WORD_EDGES}) e
"""


def word_relations(t):
    words = t.benchmark.select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)).alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(
        x.alias("a"), F.get("w", i + 1).alias("b"), (i + 1).alias("i")))
    return words.select("item_id", F.inline(pairs)).select(
        F.lit("corpus").alias("job_id"), F.col("a").alias("source_entity"), F.col("b").alias("target_entity"),
        F.when((F.col("item_id") + F.col("i")) % 2 == 0, "OWNS").otherwise("MOTHER_OF").alias("relation_type"),
        F.concat(F.lit("passage "), "item_id").alias("evidence"), F.lit(0.7).alias("confidence"),
        F.lit("benchmark").alias("source_file"), (F.col("item_id") * 1_000_000 + F.col("i")).alias("ordinal"))


def word_edges(t):
    return G.upsert_relations(None, word_relations(t), text_nodes(t))


def facts_sql(seeds: str) -> str:
    return f"""SELECT s.entity, s.type, r.rel_type, r.other, r.direction FROM ({seeds}) s LEFT JOIN (
  SELECT source AS entity, source_type AS type, type AS rel_type, target AS other, 'out' AS direction FROM ({WORD_EDGES})
  UNION ALL SELECT target, target_type, type, source, 'in' FROM ({WORD_EDGES})) r USING (entity, type)"""


_SEEDS = f"""SELECT DISTINCT name AS entity, type FROM ({MENTIONS}) WHERE chunk_id IN (SELECT doc_id FROM {{labels}} WHERE quality = 0)"""
_NAMED = f"""SELECT DISTINCT name AS entity, type FROM ({TEXT_NODES}) WHERE name IN (SELECT source FROM ({WORD_EDGES}))"""


@query("G7", facts_sql(_SEEDS))
def expand_from_chunks(t):
    flagged = t.labels.filter("quality = 0").select(F.col("doc_id").alias("chunk_id"))
    return G.expand_from_chunks(text_mentions(t), word_edges(t), flagged)


@query("G8", facts_sql(_NAMED))
def expand_from_names(t):
    e = word_edges(t)
    return G.expand_from_names(text_nodes(t), e, e.select(F.col("source").alias("name")))


IN_TEXT = f"""
SELECT DISTINCT c.conv_id * 1000 + c.turn AS question_id, n.name AS entity, n.type FROM {{conversations}} c
JOIN ({TEXT_NODES}) n ON contains(lower(c.text), lower(n.name))
"""


def questions(t):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")


@query("G9", IN_TEXT)
def entities_in_text(t):
    return G.entities_in_text(questions(t), text_nodes(t))


def dominant_sql(nodes_sql: str, edges_sql: str, links_sql: str) -> str:
    return f"""
WITH e AS ({edges_sql}), d AS (
  SELECT job_id, name, type, count(*) AS degree FROM (SELECT job_id, source AS name, source_type AS type, target, target_type, type AS k FROM e
    UNION ALL SELECT job_id, target, target_type, source, source_type, type FROM e WHERE NOT (source = target AND source_type = target_type)) GROUP BY ALL),
m AS (SELECT job_id, name, type, count(DISTINCT chunk_id) AS mentions FROM ({links_sql}) GROUP BY ALL),
p AS (SELECT n.job_id, n.name, coalesce(degree, 0) AS degree, coalesce(mentions, 0) AS mentions FROM ({nodes_sql}) n
  LEFT JOIN d USING (job_id, name, type) LEFT JOIN m USING (job_id, name, type) WHERE n.type = 'PERSON'),
r AS (SELECT *, row_number() OVER w AS rn, lead(degree) OVER w AS d2, lead(mentions) OVER w AS m2 FROM p
  WINDOW w AS (PARTITION BY job_id ORDER BY degree DESC, mentions DESC, name))
SELECT job_id, name, degree, mentions FROM r WHERE rn = 1 AND (d2 IS NULL OR degree > d2 OR m2 = 0 OR mentions >= m2 * 2)
"""


_LINKS = f"SELECT job_id, name, type, ordinal AS chunk_id FROM ({I.ENTITIES})"


@query("G10", dominant_sql(NODES, EDGES, _LINKS))
def dominant_person(t):
    links = t.sql(I.ENTITIES).select("job_id", "name", "type", F.col("ordinal").alias("chunk_id"))
    n = shared_table(nodes(t).select("job_id", "name", "type"), "nodes")
    return G.dominant_person(n, edges(t, n), links)


_MERGED = f"""
WITH a AS ({facts_sql(_SEEDS)}), b AS ({facts_sql(_NAMED)}), u AS (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 FROM b),
k AS (SELECT entity, min(src * 10 + CASE type WHEN 'ORG' THEN 0 ELSE 1 END) % 10 AS c FROM u GROUP BY entity)
SELECT k.entity, CASE c WHEN 0 THEN 'ORG' ELSE 'PERSON' END AS type, r.rel_type, r.other, r.direction FROM k
LEFT JOIN (SELECT DISTINCT entity, rel_type, other, direction FROM u WHERE rel_type IS NOT NULL) r USING (entity)
"""


def _merged(t):
    e, n = word_edges(t), text_nodes(t)
    flagged = t.labels.filter("quality = 0").select(F.col("doc_id").alias("chunk_id"))
    return G.merge_facts(G.expand_from_chunks(text_mentions(t), e, flagged),
                         G.expand_from_names(n, e, e.select(F.col("source").alias("name"))))


@query("G11", _MERGED)
def merge_facts(t):
    return _merged(t)


@query("G12", f"""
SELECT entity, type, concat(entity, ' (', type, '): ', coalesce(string_agg(DISTINCT s, '; ' ORDER BY s), 'nothing recorded')) AS fact FROM (
  SELECT *, CASE WHEN direction = 'in' THEN concat(other, ' ', rel_type, ' ', entity)
    WHEN direction = 'out' THEN concat(entity, ' ', rel_type, ' ', other) END AS s FROM ({_MERGED})) GROUP BY entity, type
""")
def fact_sentences(t):
    return G.fact_sentences(_merged(t))


@query("G13", f"""
SELECT 'node' AS kind, name AS a, type AS b, CAST(NULL AS STRING) AS c FROM ({NODES}) WHERE job_id = 'job1997'
UNION ALL SELECT 'edge', source, target, type FROM ({EDGES}) WHERE job_id = 'job1997'
""")
def full_graph(t):
    n, e = G.full_graph(nodes(t), edges(t), "job1997")
    return n.select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit(None).cast("string").alias("c")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c")))


_Q = "supplier#00000001"
_MERGED_ENT = f"""SELECT arg_min(name, ordinal) AS name, type, min(ordinal) AS ordinal, list(DISTINCT mention) FILTER (WHERE mention IS NOT NULL) AS mentions
FROM (SELECT *, lower(trim(name)) AS k FROM ({I.ENTITIES})) GROUP BY k, type"""


def _search_sql(q: str) -> str:
    return f"""
WITH e AS ({_MERGED_ENT}), h AS (
  SELECT name, CASE WHEN lower(name) = '{q}' THEN 4 WHEN contains(lower(name), '{q}') THEN 3 WHEN contains(lower(type), '{q}') THEN 2
      WHEN len(list_filter(mentions, lambda m: contains(lower(m), '{q}'))) > 0 THEN 2 END AS score,
    CASE WHEN lower(name) = '{q}' THEN 'exact name match' WHEN contains(lower(name), '{q}') THEN 'name match'
      WHEN contains(lower(type), '{q}') THEN concat('type: ', type)
      ELSE concat('also referred to as "', list_sort(list_filter(mentions, lambda m: contains(lower(m), '{q}')))[1], '"') END AS reason, 0 AS src, ordinal FROM e
  UNION ALL SELECT source_entity, 1, concat('context: "', evidence, '"'), 1, ordinal FROM ({I.RELATIONS}) WHERE contains(lower(evidence), '{q}')
  UNION ALL SELECT target_entity, 1, concat('context: "', evidence, '"'), 1, ordinal FROM ({I.RELATIONS}) WHERE contains(lower(evidence), '{q}')),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, src, ordinal, reason) AS rn FROM h WHERE score IS NOT NULL)
SELECT name, score, reason, '{q}' AS q FROM r WHERE rn = 1"""


_SEARCHES = ("supplier#000000001", "buyer 3", "order 12")


@query("G14", " UNION ALL ".join(f"SELECT * FROM ({_search_sql(q)})" for q in _SEARCHES))
def search_entities(t):
    ent = t.sql(I.ENTITIES).withColumn("mentions", F.when(F.col("mention").isNotNull(), F.array("mention")))
    merged, rel = R.dedup_entities(ent, []), t.sql(I.RELATIONS)
    found = [G.search_entities(merged, rel, q).withColumn("q", F.lit(q)) for q in _SEARCHES]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("G15", f"""
WITH e AS ({EDGES}), d AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM e UNION ALL SELECT target FROM e) GROUP BY name)
SELECT name, degree, round(5 + sqrt(degree / CAST((SELECT max(degree) FROM d) AS DOUBLE)) * 15, 6) AS radius FROM d
""")
def node_degree(t):
    return G.node_degree(edges(t)).withColumn("radius", F.round("radius", 6))


@query("G15", f"""
SELECT type, CASE WHEN type IN ('OWNS', 'EMPLOYED_BY', 'PAID', 'LOCATED_IN', 'SUBSIDIARY_OF', 'REPORTS_TO', 'TRANSACTED_WITH') THEN 'business'
  WHEN type LIKE '%\\_OF' ESCAPE '\\' THEN 'kinship' ELSE 'other' END AS category, count(*) AS n
FROM (SELECT type FROM ({EDGES}) UNION ALL SELECT type FROM ({WORD_EDGES}) UNION ALL SELECT o_orderpriority FROM {{orders}}) GROUP BY ALL
""")
def edge_categories(t):
    types = edges(t).select("type").unionByName(word_edges(t).select("type")).unionByName(
        t.orders.select(F.col("o_orderpriority").alias("type")))
    return types.groupBy("type", G.edge_category(F.col("type")).alias("category")).agg(F.count("*").alias("n"))


@query("G16", f"""
SELECT CASE WHEN source = 'Supplier#000000001' THEN target ELSE source END AS neighbour, CASE WHEN source = 'Supplier#000000001' THEN 'out' ELSE 'in' END AS direction,
  type, evidence FROM ({EDGES}) WHERE source = 'Supplier#000000001' OR target = 'Supplier#000000001'
""")
def neighbours(t):
    return G.neighbours(edges(t), "Supplier#000000001")
