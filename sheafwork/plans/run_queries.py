"""Triage, monitoring and store-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.operators import runs as J
from sheafwork.plans import inputs as I
from sheafwork.plans.registry import query
from sheafwork.plans.source_queries import DESCRIBED
from sheafwork.sources.files import describe_files

_W = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in J.CATEGORY_WEIGHT.items()) + " ELSE 0.5 END"
SCORED = f"""
SELECT path, ordinal, category, CAST({_W} AS DOUBLE) + least(len(hits), 3) * 1.5
    + least(least(log2(greatest(size_bytes, 1024) / 1024.0), 8.0) * CAST(0.1 AS DOUBLE), 0.8) AS score,
  concat(upper(category), CASE WHEN len(hits) > 0 THEN concat('; name hints: ', array_to_string(hits, ', ')) ELSE '' END) AS reason
FROM ({DESCRIBED})
"""
RANKED = f"SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, ordinal) AS rank FROM ({SCORED})"
BATCHED = f"SELECT *, (rank + 14) // 15 AS batch_no FROM ({RANKED})"


def scored(t):
    return J.score_files(describe_files(t.sql(I.LISTING)))


@query("J1", f"SELECT path, round(score, 6) AS score, reason FROM ({SCORED})")
def score_files(t):
    return scored(t).select("path", F.round("score", 6).alias("score"), "reason")


@query("J2", f"SELECT path, rank FROM ({RANKED})")
def rank_files(t):
    return J.rank_files(scored(t)).select("path", "rank")


@query("J3", f"SELECT path, rank, batch_no FROM ({BATCHED})")
def make_batches(t):
    return J.make_batches(J.rank_files(scored(t))).select("path", "rank", "batch_no")


_RESULTS = f"""SELECT path, ordinal % 7 AS entities, ordinal % 5 AS relations, ordinal % 3 AS pii, ordinal % 2 AS facts FROM ({I.LISTING})"""


@query("J5", f"""
WITH s AS (SELECT batch_no, count(*) AS file_count, string_agg(regexp_extract(path, '([^/]*)$', 1), ', ' ORDER BY rank) FILTER (WHERE (rank - 1) % 15 < 5) AS top_files,
  CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations, CAST(sum(pii) AS BIGINT) AS pii, CAST(sum(facts) AS BIGINT) AS facts
  FROM ({BATCHED}) JOIN ({_RESULTS}) USING (path) GROUP BY batch_no)
SELECT *, CAST(sum(file_count) OVER w AS BIGINT) AS running_file_count, CAST(sum(entities) OVER w AS BIGINT) AS running_entities,
  CAST(sum(pii) OVER w AS BIGINT) AS running_pii FROM s WINDOW w AS (ORDER BY batch_no)
""")
def batch_summary(t):
    batched = J.make_batches(J.rank_files(scored(t)))
    return J.batch_summary(batched, t.sql(_RESULTS), 5)


# Jobs are years, files are orders; an order's lines are its finished stages.
_JOB_FILES = """
SELECT CAST(year(o_orderdate) AS STRING) AS job_id, CASE WHEN year(o_orderdate) = 1996 THEN 'complete' ELSE 'extracting' END AS job_status,
  CAST(o_orderkey AS STRING) AS file, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'extracting' ELSE 'queued' END AS status FROM {orders}
"""
_STAGES = """
SELECT CAST(year(o_orderdate) AS STRING) AS job_id, CAST(l_orderkey AS STRING) AS file,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'skipped' ELSE 'running' END AS status
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""


@query("J6", f"""
WITH s AS (SELECT job_id, file, count(*) AS stages FROM ({_STAGES}) WHERE status <> 'running' GROUP BY ALL),
p AS (SELECT job_id, max(job_status) AS js, count(*) AS n, sum(CASE WHEN status IN ('complete', 'failed', 'skipped') THEN 7 ELSE least(coalesce(stages, 0), 6) END) AS s
  FROM ({_JOB_FILES}) LEFT JOIN s USING (job_id, file) GROUP BY job_id)
SELECT job_id, CASE WHEN js = 'complete' THEN 100.0 ELSE CAST((s * 1800 + n * 7) // (n * 14) AS DOUBLE) / 10 END AS progress_pct FROM p
""")
def progress(t):
    return J.progress(t.sql(_JOB_FILES), t.sql(_STAGES))


_ACTIVITY = """
SELECT concat(event_type, ' ', CAST(user_id % 6 AS STRING)) AS agent, CASE WHEN user_id % 6 = 5 THEN 'skipped' WHEN value > 150 AND event_type = 'error' THEN 'failed'
  WHEN value < 1 AND event_type = 'click' THEN 'running' ELSE 'completed' END AS status, CAST(floor(value * value / 10) AS BIGINT) AS duration_ms FROM {events}
"""
_AGENTS = f"""
WITH a AS (SELECT agent, bool_or(status = 'running') AS r, bool_or(status = 'failed') AS f, bool_and(status = 'skipped') AS k,
  count(*) FILTER (WHERE status <> 'running') AS done, count(*) AS total, max(greatest(coalesce(duration_ms, 0), 0)) AS max_duration_ms FROM ({_ACTIVITY}) GROUP BY agent),
m AS (SELECT coalesce(list_sort(list(max_duration_ms))[len(list(max_duration_ms)) // 2 + 1], 0) AS m FROM a WHERE max_duration_ms > 0)
SELECT agent, CASE WHEN r THEN 'running' WHEN f THEN 'failed' WHEN k THEN 'skipped' ELSE 'completed' END AS status, done, total, max_duration_ms,
  max_duration_ms > greatest((SELECT m FROM m) * 2, 4000) AS slow FROM a
"""


@query("J7", _AGENTS)
def agent_summary(t):
    return J.agent_summary(t.sql(_ACTIVITY))


_LANES = {"reading": tuple(f"{e} {i}" for e in ("click", "view") for i in range(6)), "writing": ("purchase 0", "signup 3", "idle")}


@query("J8", f"""
WITH l AS (SELECT CASE WHEN agent LIKE 'click%' OR agent LIKE 'view%' THEN 'reading' WHEN agent IN ('purchase 0', 'signup 3') THEN 'writing' END AS lane, status FROM ({_AGENTS}))
SELECT lane, CASE lane WHEN 'reading' THEN 12 ELSE 3 END AS agents, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'running') AS active
FROM l WHERE lane IS NOT NULL GROUP BY lane
""")
def lane_summary(t):
    return J.lane_summary(J.agent_summary(t.sql(_ACTIVITY)), _LANES)


@query("J9", """
SELECT event_id, CAST(floor(value) AS BIGINT) * 1000 AS duration_ms FROM {events}
""")
def activity_spans(t):
    spans = t.events.select("event_id", F.col("ts").alias("started_at"),
                            F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts")).alias("finished_at"))
    return J.activity_spans(spans).select("event_id", "duration_ms")


_QUEUE = """SELECT CAST(o_orderkey AS STRING) AS source_file, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'extracting' END AS status FROM {orders}"""
_DONE = """SELECT DISTINCT CAST(l_orderkey AS STRING) AS source_file FROM {lineitem} WHERE l_returnflag = 'R'"""


@query("J10", f"""
SELECT q.source_file, CASE WHEN d.source_file IS NULL AND status = 'queued' THEN 'skipped' ELSE status END AS stopped,
  CASE WHEN status IN ('complete', 'failed', 'skipped') THEN status ELSE 'skipped' END AS cancelled
FROM ({_QUEUE}) q LEFT JOIN ({_DONE}) d USING (source_file)
""")
def mark_skipped(t):
    files, done = t.sql(_QUEUE), t.sql(_DONE)
    stop = J.mark_skipped(files, done).withColumnRenamed("status", "stopped")
    cancel = J.mark_skipped(files, done, "cancel").withColumnRenamed("status", "cancelled")
    return stop.join(cancel, "source_file")


_COUNTS = """SELECT o_orderkey, o_orderkey % 3 AS entities, o_orderkey % 2 AS relations, o_orderkey % 5 AS pii, o_orderkey % 7 AS facts,
  o_orderkey % 11 AS tables, o_orderkey % 4 AS chunks FROM {orders}"""


def _part(c: str, one: str, many: str) -> str:
    return f"CASE WHEN {c} > 0 THEN concat({c}, ' ', CASE WHEN {c} = 1 THEN '{one}' ELSE '{many}' END) END"


@query("J11", f"""
SELECT o_orderkey, CASE WHEN s <> '' THEN s ELSE {_part('chunks', 'text chunk', 'text chunks')} END AS found FROM (SELECT *, concat_ws(' · ',
  {_part('entities', 'entity', 'entities')}, {_part('relations', 'relation', 'relations')}, {_part('pii', 'PII finding', 'PII findings')},
  {_part('facts', 'financial fact', 'financial facts')}, {_part('tables', 'table', 'tables')}) AS s FROM ({_COUNTS}))
""")
def extraction_summary(t):
    return t.sql(_COUNTS).select("o_orderkey", J.extraction_summary().alias("found"))


@query("J11", f"""
SELECT category, count(*) AS files, count(*) FILTER (WHERE status = 'complete') AS done, count(*) FILTER (WHERE status = 'skipped') AS skipped
FROM (SELECT category, CASE ordinal % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'skipped' ELSE 'queued' END AS status FROM ({DESCRIBED})) GROUP BY category
""")
def file_progress(t):
    status = F.when(F.col("ordinal") % 3 == 0, "complete").when(F.col("ordinal") % 3 == 1, "skipped").otherwise("queued")
    return J.file_progress(describe_files(t.sql(I.LISTING)).withColumn("status", status))


# Snapshots: every order is a write of its customer's job; some are unreadable.
_SNAPSHOTS = """
SELECT CAST(o_custkey AS STRING) AS job_id, o_orderkey AS written, CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS STRING)
  ELSE CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'extracting' ELSE 'failed' END END AS status FROM {orders}
"""


@query("K13", f"""
SELECT job_id, max(written) AS written, CASE WHEN arg_max(status, written) IN ('complete', 'failed') THEN arg_max(status, written) ELSE 'failed' END AS status,
  CASE WHEN arg_max(status, written) NOT IN ('complete', 'failed') THEN 'The job stopped before its end' END AS error
FROM ({_SNAPSHOTS}) WHERE status IS NOT NULL GROUP BY job_id
""")
def job_history(t):
    from sheafwork.sinks.stores import job_history as history

    return history(t.sql(_SNAPSHOTS))


@query("K10", f"SELECT row_id, OrderID, status FROM ({I.ORDERS_TABLE}) ORDER BY row_id LIMIT 50 OFFSET 100")
def library_page(t):
    from sheafwork.sinks.stores import page

    return page(t.sql(I.ORDERS_TABLE).select("row_id", "OrderID", "status"), "row_id", 50, 100)
