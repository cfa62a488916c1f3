"""Synthesis queries over findings built from the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.operators import report as P
from sheafwork.operators import responses as R
from sheafwork.plans import inputs as I
from sheafwork.plans.quality_queries import percent
from sheafwork.plans.registry import query

UNIQUE = f"""SELECT arg_min(name, (ordinal, name)) AS name, type, max(confidence) AS confidence, min(ordinal) AS ordinal,
  coalesce(string_agg(DISTINCT mention, ',' ORDER BY mention), '') AS mentions
FROM (SELECT *, lower(trim(name)) AS k FROM ({I.ENTITIES})) GROUP BY k, type"""
UNIQUE_REL = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_entity), relation_type, lower(target_entity)
  ORDER BY ordinal, job_id, source_file, source_entity, target_entity, evidence) AS rn FROM ({I.RELATIONS})) WHERE rn = 1"""


def entities(t):
    return t.sql(I.ENTITIES).withColumn("mentions", F.when(F.col("mention").isNotNull(), F.array("mention")))


def unique_entities(t):
    return R.dedup_entities(entities(t), [])


@query("R1", UNIQUE)
def dedup_corpus_entities(t):
    return unique_entities(t).withColumn("mentions", F.array_join("mentions", ","))


@query("R2", UNIQUE_REL)
def dedup_relations(t):
    return P.dedup_relations(t.sql(I.RELATIONS))


_DIGEST_FILES = f"SELECT source_file, category, CAST(NULL AS STRING) AS summary FROM ({I.FILES})"


@query("R3", f"""
WITH e AS (SELECT source_file, string_agg(concat(name, ' (', type, ')'), ', ' ORDER BY rn) AS top_entities FROM (SELECT *, row_number() OVER
    (PARTITION BY source_file ORDER BY confidence DESC, ordinal, name) AS rn FROM ({I.ENTITIES})) WHERE rn <= 10 GROUP BY source_file),
r AS (SELECT source_file, count(*) AS relations FROM ({I.RELATIONS}) GROUP BY source_file),
p AS (SELECT source_file, count(*) FILTER (WHERE severity = 'critical') AS pii_critical, count(*) FILTER (WHERE severity = 'high') AS pii_high,
  count(*) FILTER (WHERE severity = 'medium') AS pii_medium, count(*) FILTER (WHERE severity = 'low') AS pii_low FROM ({I.PII}) GROUP BY source_file),
f AS (SELECT source_file, string_agg(concat(label, '=', coalesce(CAST(amount AS STRING), 'None'), coalesce(currency, '')), '; ' ORDER BY rn) AS facts
  FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ordinal) AS rn FROM ({I.FACTS})) WHERE rn <= 8 GROUP BY source_file)
SELECT source_file, category, top_entities, coalesce(relations, 0) AS relations, coalesce(pii_critical, 0) AS pii_critical, coalesce(pii_high, 0) AS pii_high,
  coalesce(pii_medium, 0) AS pii_medium, coalesce(pii_low, 0) AS pii_low, facts FROM ({I.FILES})
LEFT JOIN e USING (source_file) LEFT JOIN r USING (source_file) LEFT JOIN p USING (source_file) LEFT JOIN f USING (source_file)
""")
def file_digest(t):
    ent = entities(t).withColumn("ordinal", F.struct("ordinal", "name"))
    out = P.file_digest(t.sql(I.FILES), ent, t.sql(I.RELATIONS), t.sql(I.PII), t.sql(I.FACTS), 10, 8)
    return out


_X = {
    "cross": f"""SELECT 'Cross-Document Entity Linkage' AS name, concat({percent('l', 't')}, '% (', l, ' of ', t, ')') AS value FROM (
      SELECT count(*) AS t, count(*) FILTER (WHERE n > 1) AS l FROM (SELECT lower(trim(name)) AS k, count(DISTINCT source_file) AS n FROM ({I.ENTITIES}) GROUP BY 1))""",
    "anomalies": f"""SELECT 'Financial Anomalies Detected' AS name, CAST(count(*) AS STRING) AS value FROM ({I.FACTS}) WHERE starts_with(upper(label), 'ANOMALY')""",
    "density": f"""SELECT 'Entity Graph Connectivity' AS name, concat(CAST(CAST((r * 200 + e) // (e * 2) AS DOUBLE) / 100 AS STRING), ' relations / entity') AS value
      FROM (SELECT (SELECT count(*) FROM ({UNIQUE})) AS e, (SELECT count(*) FROM ({UNIQUE_REL})) AS r)""",
    "exposure": f"""SELECT 'PII Exposure Score' AS name, CAST(CAST(sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS STRING) AS value FROM ({I.PII})""",
    "coverage": f"""SELECT 'High-Risk File Coverage' AS name, concat({percent('r', 't')}, '% (', r, ' of ', t, ')') AS value FROM (SELECT
      (SELECT count(DISTINCT source_file) FROM ({I.FILES})) AS t, (SELECT count(DISTINCT source_file) FROM ({I.PII}) WHERE severity IN ('critical', 'high')) AS r)""",
}
CONCENTRATION = f"""
WITH a AS (SELECT source_file, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS a FROM ({I.FACTS})
  WHERE amount IS NOT NULL AND NOT starts_with(upper(label), 'ANOMALY') GROUP BY source_file HAVING sum(amount) > 0),
o AS (SELECT DISTINCT source_file, name FROM ({I.ENTITIES}) WHERE type = 'ORG'),
s AS (SELECT source_file, a / count(*) AS share FROM o JOIN a USING (source_file) GROUP BY source_file, a)
SELECT name, sum(share) AS amount FROM o JOIN s USING (source_file) GROUP BY name
"""
_X["concentration"] = f"""SELECT 'Counterparty Concentration' AS name, concat(CAST(round_even(amount * 100 / total, 0) AS INT), '% — ', n) AS value FROM (
  SELECT name AS n, round(amount, 4) AS amount, sum(amount) OVER () AS total FROM ({CONCENTRATION})) ORDER BY amount DESC, n DESC LIMIT 1"""


@query("R4", _X["cross"])
def idx_cross_document(t):
    return P.idx_cross_document(entities(t))


@query("R5", f"SELECT name, round(amount, 2) AS amount FROM ({CONCENTRATION})")
def counterparty_amounts(t):
    return P.concentration(entities(t), t.sql(I.FACTS)).withColumn("amount", F.round("amount", 2))


@query("R6", _X["anomalies"])
def idx_anomalies(t):
    return P.idx_anomalies(t.sql(I.FACTS))


@query("R7", _X["density"])
def idx_density(t):
    return P.idx_density(unique_entities(t), P.dedup_relations(t.sql(I.RELATIONS)))


@query("R8", f"""SELECT source_file, CAST(sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS points
FROM ({I.PII}) GROUP BY source_file ORDER BY points DESC, source_file LIMIT 5""")
def exposure_worst_files(t):
    return P.worst_files(t.sql(I.PII))


@query("R9", _X["coverage"])
def idx_coverage(t):
    return P.idx_coverage(t.sql(I.FILES), t.sql(I.PII))


@query("R10", " UNION ALL ".join(f"SELECT * FROM ({s})" for s in _X.values()))
def corpus_overview(t):
    ent, rel = entities(t), t.sql(I.RELATIONS)
    return P.corpus_overview(t.sql(I.FILES), ent, rel, t.sql(I.PII), t.sql(I.FACTS),
                             R.dedup_entities(ent, []), P.dedup_relations(rel))


_DOC_CHUNKS = """SELECT concat(source, '/doc_', CAST(doc_id AS STRING), '.txt') AS source_file, 0 AS chunk_no, text FROM {documents}"""
_TABLE_FILES = f"SELECT DISTINCT source_file, concat('t_', substr(source_file, 8, 4)) AS table_id FROM ({I.RELATIONS})"
BREAKDOWN = f"""
SELECT source_file, category, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relations, coalesce(p.n, 0) AS pii_findings,
  coalesce(f.n, 0) AS financial_facts, coalesce(b.n, 0) AS tables, coalesce(c.n, 0) AS chunks FROM ({I.FILES})
LEFT JOIN (SELECT source_file, count(*) AS n FROM ({I.ENTITIES}) GROUP BY 1) e USING (source_file)
LEFT JOIN (SELECT source_file, count(*) AS n FROM ({I.RELATIONS}) GROUP BY 1) r USING (source_file)
LEFT JOIN (SELECT source_file, count(*) AS n FROM ({I.PII}) GROUP BY 1) p USING (source_file)
LEFT JOIN (SELECT source_file, count(*) AS n FROM ({I.FACTS}) GROUP BY 1) f USING (source_file)
LEFT JOIN (SELECT source_file, count(*) AS n FROM ({_TABLE_FILES}) GROUP BY 1) b USING (source_file)
LEFT JOIN (SELECT source_file, count(*) AS n FROM ({_DOC_CHUNKS}) GROUP BY 1) c USING (source_file)
"""
_QUIET = "(entities = 0 AND relations = 0 AND pii_findings = 0 AND financial_facts = 0 AND tables = 0)"


def breakdown(t):
    return P.file_breakdown(
        t.sql(I.FILES), entities=entities(t), relations=t.sql(I.RELATIONS), pii_findings=t.sql(I.PII),
        financial_facts=t.sql(I.FACTS), tables=t.sql(_TABLE_FILES), chunks=t.sql(_DOC_CHUNKS))


@query("R11", BREAKDOWN)
def file_breakdown(t):
    return breakdown(t)


@query("R12", f"""SELECT category, count(*) AS file_count, min(source_file) AS first_file, max(source_file) AS last_file, CAST(sum(chunks) AS BIGINT) AS chunks
FROM ({BREAKDOWN}) WHERE {_QUIET} GROUP BY category HAVING count(*) >= 2""")
def file_groups(t):
    return P.file_groups(breakdown(t))


@query("R12", f"""WITH b AS ({BREAKDOWN}) SELECT * FROM b WHERE NOT {_QUIET}
  OR category IN (SELECT category FROM b WHERE {_QUIET} GROUP BY category HAVING count(*) < 2)""")
def individual_files(t):
    return P.individual_files(breakdown(t)).select("source_file", "category", *P.SIGNALS, "chunks")


@query("R13", f"""
WITH n AS (SELECT source_file, string_agg(name, ', ' ORDER BY name) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY name) AS rn
  FROM (SELECT DISTINCT source_file, name FROM ({I.ENTITIES}))) WHERE rn <= 12 GROUP BY 1),
p AS (SELECT source_file, string_agg(DISTINCT category, ', ' ORDER BY category) AS pii_types FROM ({I.PII}) GROUP BY 1)
SELECT source_file, category, category IN ('pdf', 'image') AS has_preview, coalesce(entities, '') AS entities, coalesce(pii_types, '') AS pii_types,
  substr(text, 1, 280) AS text_excerpt FROM ({I.FILES}) LEFT JOIN n USING (source_file) LEFT JOIN p USING (source_file) LEFT JOIN ({_DOC_CHUNKS}) USING (source_file)
""")
def document_cards(t):
    return P.document_cards(t.sql(I.FILES), entities(t), t.sql(I.PII), t.sql(_DOC_CHUNKS), 12, 280)


_JOB = "concat('job', CAST(year(o_orderdate) AS STRING))"
_JOBS = f"SELECT {_JOB} AS job_id, CAST(count(*) AS DOUBLE) / 10 AS seconds FROM {{orders}} GROUP BY 1"
_JOB_FILES = f"SELECT {_JOB} AS job_id, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'complete' END AS status FROM {{orders}}"


@query("R14", f"""
SELECT job_id, processed, unprocessed, entities, relations, pii_findings, CASE WHEN NOT seconds > 0 THEN '—'
  WHEN round(seconds) < 60 THEN concat(CAST(round(seconds) AS BIGINT), 's')
  ELSE concat(CAST(round(seconds) AS BIGINT) // 60, 'm ', CAST(round(seconds) AS BIGINT) % 60, 's') END AS elapsed
FROM ({_JOBS}) JOIN (SELECT job_id, count(*) FILTER (WHERE status = 'complete') AS processed, count(*) FILTER (WHERE status <> 'complete') AS unprocessed
  FROM ({_JOB_FILES}) GROUP BY 1) USING (job_id)
JOIN (SELECT job_id, count(*) AS entities FROM ({I.ENTITIES}) GROUP BY 1) USING (job_id)
JOIN (SELECT job_id, count(*) AS relations FROM ({I.RELATIONS}) GROUP BY 1) USING (job_id)
JOIN (SELECT job_id, count(*) AS pii_findings FROM ({I.PII}) GROUP BY 1) USING (job_id)
""")
def job_totals(t):
    return P.job_totals(t.sql(_JOBS), t.sql(_JOB_FILES), entities=entities(t), relations=t.sql(I.RELATIONS),
                        pii_findings=t.sql(I.PII))


@query("R14", f"SELECT source_file, table_id, category, 2 AS category_rank FROM ({_TABLE_FILES}) JOIN ({I.FILES}) USING (source_file)")
def table_listing(t):
    return P.table_listing(t.sql(_TABLE_FILES), t.sql(I.FILES))


_GIVEN = f"SELECT DISTINCT {_JOB} AS job_id, CASE WHEN year(o_orderdate) % 2 = 0 THEN 'Trade grew.' END AS executive_summary, CAST(NULL AS STRING) AS key_entities FROM {{orders}}"
_JOB_ENT = f"""SELECT job_id, arg_min(name, (ordinal, name)) AS name, type, min(ordinal) AS ordinal FROM (SELECT *, lower(trim(name)) AS k FROM ({I.ENTITIES})) GROUP BY job_id, k, type"""


@query("R15", f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal, name) AS rn FROM ({_JOB_ENT})),
c AS (SELECT job_id, count(*) AS entities, string_agg(name, ', ' ORDER BY rn) FILTER (WHERE rn <= 15) AS first FROM e GROUP BY 1),
r AS (SELECT job_id, count(*) AS relations FROM ({I.RELATIONS}) GROUP BY 1), p AS (SELECT job_id, count(*) AS pii_findings FROM ({I.PII}) GROUP BY 1)
SELECT job_id, coalesce(g.executive_summary, concat('No summary was given; ', entities, ' entities and ', pii_findings,
  ' personal data findings are listed by file')) AS executive_summary,
  coalesce(g.key_entities, first) AS key_entities, entities, relations, pii_findings
FROM ({_JOBS}) JOIN c USING (job_id) JOIN r USING (job_id) JOIN p USING (job_id) LEFT JOIN ({_GIVEN}) g USING (job_id)
""")
def synthesize(t):
    ent = R.dedup_entities(entities(t), ["job_id"]).withColumn("ordinal", F.struct("ordinal", "name"))
    return P.synthesize(t.sql(_JOBS).select("job_id"), t.sql(_GIVEN), ent, t.sql(I.RELATIONS), t.sql(I.PII), 15)


@query("K2", f"""SELECT severity, category, value_redacted, source_file, location FROM ({I.PII})""")
def inventory_rows(t):
    from sheafwork.operators.sensitive import pii_inventory as inventory
    from sheafwork.sinks.exports import inventory_rows as rows

    return rows(inventory(t.sql(I.PII), order=("finding_id",)))
